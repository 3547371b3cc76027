"""The pipeline against a brute-force version of its stages, and the registration of its queries."""

from collections import Counter

import public_tokenizers

import __spark_entry__ as entry
import corpus_pipeline
from cytolake.llm import decontaminate, pieces, quality, secrets

from .conftest import prose
from .test_documents import base_spans, brute_classes, brute_leaks, entropy_spans, print_of


def test_run_equals_brute_force(spark, docs, texts, tmp_path):
    items = [(1, prose(50, 40)), (2, prose(51, 12))]
    extra = [(300, prose(80, 300) + " " + prose(50, 40) + " " + prose(81, 100), "en", "a", 5), (301, prose(82, 200) + " " + prose(51, 12), "en", "a", None)]
    more = spark.createDataFrame([(*t,) for t in texts] + extra, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    more.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "secret_scans", "sentencepiece"]
    assert got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = [tuple(r) for r in quality.keep_good(more).collect()]          # itself tested against brute force
    roots = brute_classes([print_of(r[1]) for r in kept])
    least = {}
    for r in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0)):
        least.setdefault(roots[print_of(r[1])], r)
    rows = list(least.values())
    hit = {d for d, _ in brute_leaks([(r[0], r[1]) for r in rows], items)}
    want = []
    for doc_id, t, *_ in (r for r in rows if r[0] not in hit):
        out, at = "", 0
        for a, _, _, e in sorted(base_spans(t) + entropy_spans(t)):
            if a >= at:
                out += t[at:a] + secrets.MARK
            at = max(at, e)
        want.append((doc_id, out + t[at:]))
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert {300, 301} <= hit
    model = pieces.Pieces(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    assert all(r.round_trip and model.decode(r.piece_ids) == r.text for r in got.collect())


def test_registered():
    names = entry.queries()
    assert all(Counter(n.split("_")[0] for n in names)[f"op{k}"] == 1 for k in range(1, 11)) and "pipeline" in names


def test_items_are_bounded():
    items = decontaminate.Items([(i, prose(i, 30)) for i in range(5)])
    assert all(len(v) for v in items.sizes.values()) and len(items.ids) == 5
