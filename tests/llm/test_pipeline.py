"""The pipeline's stages against plain Python, and the registered queries of this package."""

import hashlib
import zlib
from collections import Counter

import corpus_pipeline
from synthkit.llm.common import materialize
from synthkit.llm.simhash_dedup import fingerprint
from tests.conftest import SF01
from tests.llm.conftest import SF
from tests.llm.test_tables import check_packing, plain_components
from tests.llm.test_text_scans import brute_base, brute_contamination


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    clean = materialize(stages["toxicity"](spark, docs, SF), "t1")
    assert clean.columns == docs.columns and set(clean.collect()) <= set(docs.collect()) and clean.count() > 0.6 * docs.count()

    unique = materialize(stages["near_duplicates"](spark, clean, SF), "t2")
    prints = {r.doc_id: fingerprint(r.text.encode()) for r in clean.collect()}
    root, first = plain_components(sorted(set(prints.values())), 2), {}
    for d, p in sorted(prints.items()):
        first.setdefault(root[p], d)
    assert sorted(r.doc_id for r in unique.collect()) == sorted(first.values())

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    decontaminated = materialize(stages["decontamination"](spark, unique, SF), "t3")
    hit = {d: n for d, _, n, _ in brute_contamination([(r.doc_id, r.text) for r in unique.collect()], items)}
    assert sorted(r.doc_id for r in decontaminated.collect()) == sorted(d for d, n in hit.items() if not n)

    redacted = materialize(stages["secrets"](spark, decontaminated, SF), "t4")
    before = {r.doc_id: r for r in decontaminated.collect()}
    assert redacted.columns == docs.columns and redacted.count() == len(before)
    for r in redacted.collect():
        assert r.n_chars == len(r.text) and not brute_base(r.text)
        assert r.text == before[r.doc_id].text or brute_base(before[r.doc_id].text)

    rows = stages["packing"](spark, redacted, SF).collect()
    assert {r.doc_id for r in rows} == set(before)
    check_packing(rows, 1024)


def test_run_and_registration(spark):
    import __spark_entry__ as e
    names = list(e.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    rows = corpus_pipeline.run(spark, SF).collect()
    check_packing(rows, 1024)
    assert rows and Counter(r.piece for r in rows)[0] == len({r.doc_id for r in rows})


def test_op2_holds_out_a_quarter(spark):
    import __spark_entry__ as e
    for r in e.queries()["op2_toxicity"](spark, SF).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3)


def test_op9_counts_and_digests(spark):
    import __spark_entry__ as e
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    names = ("assign", "access", "hex")
    found = 0
    for r in e.queries()["op9_secrets"](spark, SF01).collect():
        base = brute_base(texts[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in base) for i in range(3)]
        joined = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and set(joined.split(",")) <= {*r.spans.split(","), ""}
        found += len(base)
    assert found


def test_op5_counts_kinds_and_leaves_clean_texts(spark):
    import __spark_entry__ as e
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = e.queries()["op5_pseudonyms"](spark, SF).collect()
    assert len(rows) == len(texts) and sum(r.n_private for r in rows)
    for r in rows:
        assert r.n_private == r.n_email + r.n_iban + r.n_ip + r.n_date + r.n_ssn + r.n_phone + r.n_card
        assert (r.text != texts[r.doc_id]) == (r.n_private > 0) and len(r.text) >= len(texts[r.doc_id]) - 20
