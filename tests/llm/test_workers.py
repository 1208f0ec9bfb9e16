"""What Python workers hold and do: one worker a task, one table a worker, compact word numbers."""

import numpy as np

from synthkit.llm import common, secret_scan, toxicity

TEXTS = ["", None, "one", "Two words", "a longer text of some more words, one and two", "ünï çödé ünï 日本語 wörter", "x" * 40 + " abcd abcde abcdef abcdefg"]


def test_redaction_takes_one_worker_a_task(spark, edge):
    done = secret_scan.redact(edge)
    assert done._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    spans = {(r.doc_id, r.text): r.spans_ for r in secret_scan.scan_secrets(edge).collect()}
    for (key, text), where in spans.items():
        out, at = "", 0
        for s in where:
            if s.end > at:
                out, at = out + (text[at:s.start] + "[SECRET]" if s.start >= at else ""), s.end
        want = out + text[at:] if where else text
        assert want in [r.text for r in done.where("doc_id <=> " + ("null" if key is None else str(key))).collect()]


def test_training_drops_the_table_of_an_earlier_step(spark):
    rows = spark.createDataFrame([(i, i % 2, f"text {i}") for i in range(400)], "id long, y int, text string").repartition(32)

    def hold(batches):
        common.worker_table("earlier", lambda: [0])
        yield from batches

    held = toxicity._by_shard(rows.mapInArrow(hold, rows.schema), 64, lambda shard, texts, labels: {0: np.array([len(common._TABLE)])})
    assert toxicity._sums(held)[0][0] == 0


def test_words_are_numbered_compactly_and_scored_as_the_network_does():
    docs, ids, share, seen = toxicity.indexed([t or "" for t in TEXTS])
    assert all(d.dtype.itemsize == 4 for d in docs)
    index = [""] + list(dict.fromkeys(w for t in TEXTS for w in toxicity.words(t)))
    for i, w in enumerate(index[1:], 1):
        f = toxicity.features(w)
        assert list(ids[i]) == f + [toxicity.BUCKETS] * (len(ids[i]) - len(f)) and share[i] == np.float32(1 / len(f))
    for t, d in zip(TEXTS, docs):
        assert [index[i] for i in d if i] == toxicity.words(t) and len(d) == max(1, len(toxicity.words(t))) + 2
    assert seen[toxicity.features("one")[0]] == 2
    net = toxicity.Network.new()
    whole, small = toxicity.Scorer(net), toxicity.Scorer(net, most=6)
    for t in TEXTS:
        e = np.array([net.embedding[toxicity.features(w)].mean(axis=0) for w in toxicity.words(t)] or [np.zeros(toxicity.DIM)])
        e = np.concatenate([e, np.zeros((2, toxicity.DIM))])
        best = [max(np.concatenate(e[i:i + w]) @ f[:, k] for i in range(len(e) - 2)) + b[k]
                for w, f, b in zip(toxicity.WIDTHS, net.filters, net.bias) for k in range(toxicity.FILTERS)]
        want = np.maximum(best, 0) @ net.out + net.out_bias
        assert np.isclose(whole.output(t), want, atol=1e-4) and whole.output(t) == small.output(t) == whole.output(t)
