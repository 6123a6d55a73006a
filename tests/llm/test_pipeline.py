"""The pipeline against a plain Python version, and the queries against their SQL twins."""

import re
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from compare import difference, oracle
from conftest import SMALL
from test_corpus_operators import _base, _components
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tagwright import storage
from tagwright.llm import queries, stages
from tagwright.llm.stages import COLUMNS


@pytest.mark.parametrize("key", sorted(queries.ORACLE_SQL))
def test_twin(spark, key):
    df = queries.QUERIES[key](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert difference(df, oracle(SMALL), queries.ORACLE_SQL[key]) is None


def test_every_operator_is_registered():
    names = [k for k in entry.queries() if re.match(r"op\d+_", k)]
    assert sorted(int(k[2:].split("_")[0]) for k in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert "op6_reply_trees" in entry.oracle_sql()


def test_native_operator_runs_no_python(spark):
    plan = queries.QUERIES["op6_reply_trees"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def _tokens(text):
    """Letters and digits, A-Z lower-cased, as numbers that are equal for equal words."""
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    return re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", (text or "").translate(low))


def _leaks(text, items):
    """Is there a stretch of 13 words or more (or a whole shorter item) of which 80 percent are equal at some shift?"""
    words = _tokens(text)
    code = {w: i for i, w in enumerate(dict.fromkeys(words))}
    doc = np.array([code[w] for w in words])
    for item in items:
        least = min(13, len(item))
        other = np.array([code.get(w, -1) for w in item])
        for shift in range(-len(other) + 1, len(doc)):
            low, high = max(0, -shift), min(len(other), len(doc) - shift)
            same = doc[low + shift:high + shift] == other[low:high]
            if high - low < least or 100 * same.sum() < 80 * least or not least:
                continue
            gain = np.concatenate([[0], np.cumsum(np.where(same, 20, -80))])
            if (gain[least:] - np.minimum.accumulate(gain[:len(gain) - least])).max() >= 0:
                return True
    return False


def _redacted(text):
    out, last = [], 0
    for kind, a, b in sorted(_base(text or ""), key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"[{kind}]"]
        last = max(last, b)
    return "".join(out) + (text or "")[last:]


def test_pipeline_equals_brute_force(spark):
    con = oracle(SMALL)
    docs = con.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({queries.ORACLE_SQL['op1_quality_rules']}) WHERE kept").fetchall()}
    rows = [r for r in docs if r[0] in kept]
    rows = [r for r, (doc_id, _, least) in zip(rows, _components(rows, 5, 80)) if doc_id == least]
    items = [_tokens(t) for (t,) in con.execute("SELECT text FROM benchmark").fetchall()]
    rows = [(d, _redacted(t)) for d, t in rows if not _leaks(t, items)]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {d: tokenizer.encode(t, add_special_tokens=False).ids + [1] for d, t in rows}
    parts = defaultdict(list)
    windows = defaultdict(int)
    for r in corpus_pipeline.run(spark, SMALL).collect():
        parts[r.doc_id].append((r.start, np.frombuffer(bytes(r.ids), dtype="<u4").tolist()))
        windows[r.sequence_id] += r.length
    got = {d: [i for _, ids in sorted(p) for i in ids] for d, p in parts.items()}
    assert got == want and len(want) < len(docs)
    assert all(n == 2048 for s, n in windows.items() if s != max(windows))


def test_stages_return_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), SMALL)
        assert out.columns == COLUMNS and out.collect() == []


def test_every_stage_bounds_its_batches(spark):
    def sizes(spark, docs, sf_dir):
        return docs.mapInArrow(lambda batches: (b.from_pydict({"n": [b.num_rows]}) for b in batches), "n bigint")

    many, key = spark.range(0, 9000, 1, 1), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    got = stages._in_batches(sizes)(spark, many, SMALL)
    assert spark.conf.get(key) == before
    assert sorted(r["n"] for r in got.collect()) == [1000, 2000, 2000, 2000, 2000]
    assert all(stage.__wrapped__ for _, stage in corpus_pipeline.STAGES)


def test_stages_leave_no_texts_behind(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        stored = storage._run_folder(spark).removeprefix("file:")
        before = set(Path(stored).iterdir())
        out = stage(spark, docs, SMALL)
        left = [p for p in set(Path(stored).iterdir()) - before if list(p.glob("*.parquet"))]
        assert left and all("text" not in spark.read.parquet(str(p)).columns for p in left)
        assert out.columns == COLUMNS and out.count() > 0


def test_rules_and_redactions_go_by_the_whole_row(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(i, f"{text} {i}", "en", None, 0) for i in range(5)] + [(9, None, "en", "a", 0), (10, "", None, "en", 0), (11, "# " * 20, "en", "a", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(r.doc_id for r in stages.quality_rules(spark, df, SMALL).collect()) == list(range(5))
    rows = [(1, "\U0001f600é a@b.co, +1 555 010 1000\n10.0.0.1"), (2, None), (3, ""), (4, "\U0001f600é a@b.co, +1 555 010 1000\n10.0.0.1"), (None, "no data")]
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], df.schema)
    got = {r.doc_id: (r.text, r.n_chars) for r in stages.personal_data(spark, df, SMALL).collect()}
    want = {i: _redacted(t) if t is not None else None for i, t in rows}
    assert want[1] == "\U0001f600é [email], [phone]\n[ip]" and got == {i: (t, None if t is None else len(t)) for i, t in want.items()}
