import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraflux.llm import chat, licences, pieces

# Chat formatting

ROWS = [(1, 2, "user", "a\\"), (1, 1, "user", "\\\\### </turn> ####\\###x"), (1, 3, "assistant", ""), (1, 4, "assistant", "<next/>\n</turn>\n### user:\n"), (1, 4, "assistant", "again\\\\"), (None, None, None, None), (2, None, "a:b%\n", "x"), (2, 0, "assistant", "\n</turn>\n\\"), (3, 0, "assistant", "### " * 3), (3, 0, "assistant", "### " * 3), (4, 0, "system", "\U0001f600 ###")]


def turns(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, turns string, blocks string")


def test_round_trip(spark):
    made = chat.format_chats(turns(spark)).select("*", chat.read_back(F.col("formatted")).alias("read")).collect()
    for r in made:
        own = sorted(((t is not None, t, role or "", text or "") for c, t, role, text in ROWS if c == r.conv_id), key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
        assert [tuple(x) for x in r.read] == [x[2:] for x in own]
        learned = [x[3] for x in own if x[2] == "assistant"]
        spans = [r.formatted[s.start - 1 : s.start - 1 + s.length] for s in r.loss_spans]
        assert [re.sub(r"\\(\\*)(###|</turn>|<next/>)", r"\1\2", s) for s in spans] == learned
        assert len(re.findall(r"(?<!\\)</turn>", r.formatted)) == len([1 for k, x in enumerate(own) if k == 0 or own[k - 1][2] != x[2]])


def test_digest(spark):
    got = {r.conv_id: r for r in chat.digest(turns(spark)).collect()}
    r = got[1]
    assert r.n_turns == 5 and r.loss_chars == len("<next/>\n</turn>\n### user:\n") + len("again\\\\")
    assert r.loss_sha256 == hashlib.sha256(b"<next/>\n</turn>\n### user:\nagain\\\\").hexdigest()
    assert got[4].loss_chars == 0 and got[4].formatted_chars == len("### system:\n\U0001f600 \\###\n</turn>\n")
    assert chat.digest(turns(spark, [])).count() == 0
    plan = chat.digest(turns(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_random_texts(spark):
    rng = random.Random(0)
    parts = ["\\", "###", "#", "</turn>", "<next/>", "\n", "a", " ", "</turn", "%", ":", "\U0001f600"]
    rows = [(c, t, rng.choice(["user", "assistant"]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))) for c in range(40) for t in range(6)]
    read = chat.format_chats(turns(spark, rows)).select("conv_id", chat.read_back(F.col("formatted")).alias("t")).collect()
    for r in read:
        assert [tuple(x) for x in r.t] == [x[2:] for x in rows if x[0] == r.conv_id]


def test_queries_against_duckdb(spark, sf):
    import duckdb

    from terraflux.llm import queries

    c = duckdb.connect()
    for t in ("embeddings", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, sf)
        columns = sorted(got.columns)
        assert sorted(tuple(r[x] for x in columns) for r in got.collect()) == sorted(c.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())


# License scans


def brute_match(template, words):
    """The best score of a template against any stretch, by the full alignment table."""
    score = np.zeros(len(words) + 1, int)
    for t in template:
        row = [score[0] - 1]
        for j, w in enumerate(words):
            row.append(max(score[j] + (1 if w == t else -1), score[j + 1] - 1, row[-1] - 1))
        score = np.array(row)
    return int(score.max())


def test_scan_finds_what_full_alignment_finds(spark, make):
    rng = random.Random(1)
    filler = [f"w{k}" for k in range(50)]
    rows = []
    for i in range(60):
        w = [rng.choice(filler) for _ in range(rng.randint(0, 60))]
        if i % 2:
            t = licences.words_of(licences.TEMPLATES[rng.choice(list(licences.TEMPLATES))])
            t = [x.decode() for x in t]
            for _ in range(rng.randint(0, max(0, len(t) // 15))):
                t[rng.randrange(len(t))] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = t
        rows.append((i, " ".join(w)))
    got = {(r.doc_id, r.license): r for r in licences.scan(make(rows), least=0.8).collect()}
    for i, text in rows:
        words = licences.words_of(text)
        for name, t in licences.TEMPLATES.items():
            template = licences.words_of(t)
            best = brute_match(template, words)
            if best >= 0.85 * len(template):
                assert (i, name) in got
            if (i, name) in got:
                r = got[i, name]
                assert r.coverage >= 0.8 and best >= 0.5 * len(template)
                span = licences.words_of(text[r.first_char : r.end_char])
                assert span == words[r.first_word : r.last_word + 1]


def test_scan_edges(spark, make):
    mit = licences.TEMPLATES["MIT"]
    rows = [(1, None), (2, ""), (3, mit), (3, mit), (None, mit), (4, f"é {mit} x " * 2), (5, "released under"), (6, "word " * 100000 + mit.upper())]
    got = [(r.doc_id, r.license, r.coverage, r.first_char) for r in licences.scan(make(rows)).collect()]
    assert sorted(got, key=str) == sorted([(3, "MIT", 1.0, 0)] * 2 + [(None, "MIT", 1.0, 0), (4, "MIT", 1.0, 2), (4, "MIT", 1.0, 2 + len(mit) + 5), (6, "MIT", 1.0, 500000)], key=str)
    assert licences.scan(make([])).count() == 0
    assert licences.scan(make(rows), {}).count() == 0


def test_short_notices_lack_a_word(spark, make):
    """Any one word of five, and any one of a notice of one to nine words that may lack it."""
    rng = random.Random(4)
    templates = {f"t{n}": " ".join(f"w{n}x{k}" for k in range(n)) for n in (1, 2, 3, 5, 6, 7, 9, 10, 15)}
    rows, wanted = [], set()
    for n, t in enumerate(templates.values()):
        w = t.split()
        for lacks in range(int(0.2 * len(w) + 1e-9) + 1):
            for _ in range(4):
                at = set(rng.sample(range(len(w)), lacks))
                rows.append((len(rows), " ".join(["before", *["other" if k in at else x for k, x in enumerate(w)], "after"])))
                wanted.add((len(rows) - 1, list(templates)[n]))
    got = {(r.doc_id, r.license) for r in licences.scan(make(rows), templates, 0.8).collect()}
    assert wanted <= got


# SentencePiece


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_encoding_matches_the_library(tables, library):
    own = pieces.model("piece_bpe_32k.model")
    rng = random.Random(2)
    alphabet = "abcdehilnorst    .,\n\u00e9\u2581\U0001f600"
    texts = ["", "  ", "a  \u2581b", " \n\t x", "\u65e5\u672c\u8a9e", "    def f(x):\n        return x+1  ", "x" * 300] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(800)]
    texts += [r.text for r in tables("documents").collect()]
    got = own.encode(texts)
    assert [x.tolist() for x in got] == library.encode(texts)
    assert [own.decode(x.tolist()) for x in got] == [t.replace("\u2581", " ") for t in texts]


def test_memory_limits(monkeypatch, library):
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    monkeypatch.setattr(pieces, "INDEXED", 64)
    own = pieces.Model(__import__("public_tokenizers").path("piece_bpe_32k.model"))
    monkeypatch.setattr(pieces, "LONGEST", 6)
    texts = [" ".join(f"word{k * j}" for k in range(40)) for j in range(10)] + ["".join("abcdetionhe"[k * k % 11] for k in range(700))]
    assert [x.tolist() for x in own.encode(texts)] == library.encode(texts)


def test_table(spark, make, library):
    rows = [(1, None), (2, ""), (None, "no id"), (3, "same"), (3, "same"), (4, "long text " * 20000)]
    got = pieces.encode(make(rows)).collect()
    assert sorted(((r.doc_id, r.ids) for r in got), key=str) == sorted(((i, library.encode(t or "")) for i, t in rows), key=str)
    assert all(r.exact and r.n_ids == len(r.ids) for r in got)
    assert pieces.encode(make([])).count() == 0
    back = pieces.encode(make(rows)).select(pieces.decode_column(F.col("ids")).alias("t")).collect()
    assert sorted(r.t for r in back) == sorted(t or "" for _, t in rows)
