"""The pipeline against a plain Python version of its stages, and the entry without the optional folders."""

import hashlib
import os
import random
import re
import shutil
import struct
import subprocess
import sys
from pathlib import Path

import pytest

from .test_native_operators import brute_counts
from .test_text_operators import brute_components, brute_fingerprint, brute_hits, tiktoken_encoding

ROOT = Path(__file__).resolve().parents[2]


def write(spark, folder, rows, benchmark):
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(i, 1, 0) for i, *_ in rows[:20]]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def brute(rows, benchmark):
    """Too few labels certify a cutoff, and no token is long, so base rules and base patterns decide."""
    kept = []
    for i, text, *_ in rows:
        n, _, _, _, repeats = brute_counts(text)
        if n >= 10 and 100 * repeats <= 20 * n:
            kept.append((i, text))
    group = brute_components([brute_fingerprint(t) for _, t in kept])
    first = {}
    for (i, _), g in zip(kept, group):
        first[g] = min(first.get(g, i), i)
    kept = [(i, t) for (i, t), g in zip(kept, group) if first[g] == i]
    kept = [(i, t) for i, t in kept if not brute_hits(t, benchmark)[1]]
    encoding, out = tiktoken_encoding(), {}
    for i, t in kept:
        t = re.sub(r"""(?:password|token) ?[:=] ?"?[A-Za-z0-9]{6,}""", "[SECRET]", t)
        ids = encoding.encode_ordinary(t)
        out[i] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    return out


def test_pipeline_equals_plain_python(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    words = "stone river über cloud Märchen green light seven house 42 walk".split()

    def prose(n):
        return " ".join(rng.choice(words) + str(rng.randrange(500)) for _ in range(n))

    benchmark = [(1, prose(14)), (2, prose(30)), (None, "")]
    texts = [None, "", "short text", "word " * 50, prose(9), prose(10)] + [prose(200) for _ in range(15)]
    texts += [texts[8], texts[9] + " one more", texts[10].replace("river", "brook", 1)]
    texts += [prose(40) + " " + benchmark[0][1] + " " + prose(40), prose(30) + " " + " ".join(benchmark[1][1].upper().split()[3:20])]
    texts += [prose(60) + " password=abc123xyz " + prose(5), prose(60) + ' token = "a1b2c3d4e5" ' + prose(5)]
    rows = [(i, t, rng.choice(["en", "de", None]), "src0", len(t or "")) for i, t in enumerate(texts)]
    write(spark, tmp_path, rows, benchmark)
    want = brute(rows, benchmark)
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want and 10 < len(want) < len(texts) - 8
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline

    write(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("gone", [True, False])
def test_entry_with_and_without_the_optional_folders(tmp_path, gone):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(ROOT / name, tmp_path)
    shutil.copytree(ROOT / "fragloom", tmp_path / "fragloom", ignore=shutil.ignore_patterns("__pycache__", *(["llm"] if gone else [])))
    code = ("import __spark_entry__ as e; import fragloom; print(fragloom.__file__); n = e.queries();"
            "print(sum(k == 'pipeline' or k.startswith('op') and k[2].isdigit() for k in n), len(n))")
    outside = [p for p in sys.path if p and Path(p).resolve() != ROOT]
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=100,
                         env={**os.environ, "PYTHONPATH": os.pathsep.join([str(tmp_path), *outside])})
    assert out.stdout, out.stderr[-500:]
    where, numbers, total = out.stdout.split()
    assert Path(where).is_relative_to(tmp_path) and numbers == ("0" if gone else "14") and int(total) > 90
