import zlib

import numpy as np
import pytest

from terraflux.llm import packing

VOCABULARY = ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(VOCABULARY[0]))


ODD = ["a   b \n\n c  \td  ", "", "x <|endoftext|> y  z", " lead trail ", "it's we'll 12 345 x \u3000 \ufb01 \u00e9 \u2019s \U0001f600 \U0001f600", "a   b  c \n d\r\n e\t f", "  ", " ", "\n", "a \u00a0 b", "1 2  3 !? ...", "ends with space \n ", "\u2028 x \u2028y", "don't 'S  's", "\x00 \x1f y"]


def test_encoder_matches_the_library(spark, tables, library):
    own = packing.encoder(*VOCABULARY)
    texts = ODD + [r.text for r in tables("documents").collect()]
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t[:60]


def test_a_text_is_encoded_at_once_and_a_long_one_in_parts(library, monkeypatch):
    own = packing.Encoder(*VOCABULARY)
    units, seen = own.units, []

    class Counted:
        def encode_ordinary(self, text):
            seen.append(text)
            return units.encode_ordinary(text)

    own.units = Counted()
    own.encode(" ".join(f"word{k}" for k in range(1000)))
    assert len(seen) == 1
    for t in [*ODD, " ".join(x.strip() + " \x1c y" for x in ODD) * 3]:
        if "<|endoftext|>" in t:
            t = t.replace("<|endoftext|>", "end")
        for size in (1, 2, 3, 7):
            monkeypatch.setattr(packing, "PART", size)
            assert "".join(packing.parts(t)) == t
            assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, (t, size)
    assert len(seen) > 200 and max(len(x) for x in seen[-20:]) < 40


def check(pieces, docs, library, capacity):
    wanted = {}
    for i, t in docs:
        wanted.setdefault(i, []).append(np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4"))
    sequences = {}
    by_doc = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
        by_doc.setdefault(p.doc_id, []).append(p)
    padding = 0
    for ps in sequences.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= capacity
        padding += capacity - at if at & (at - 1) else 0
    for i, many in wanted.items():
        if len(many) == 1:
            at = 0
            for p in sorted(by_doc[i], key=lambda p: p.start):
                assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(many[0]), zlib.crc32(many[0][at : at + p.length].tobytes()))
                at += p.length
            assert at == len(many[0])
        else:
            assert sum(p.length for p in by_doc[i]) == sum(map(len, many))
    assert set(by_doc) == set(wanted)
    return padding


@pytest.mark.parametrize("capacity", [2048, 64, 1])
def test_pieces(spark, tables, library, capacity):
    docs = tables("documents") if capacity == 2048 else tables("documents").limit(10)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert check(packing.pack(frame, capacity).collect(), rows, library, capacity) == 0


def test_edges(spark, make, library):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(100, None), (None, "no id"), (101, "same"), (101, "same"), (102, "long " * 30000)]
    got = packing.pack(make(rows).repartition(3), 256, with_ids=True).collect()
    assert check(got, rows, library, 256) == 0
    assert all(len(p.ids) == p.length for p in got)
    assert packing.pack(make([])).count() == 0
    with pytest.raises(ValueError):
        packing.pack(make(rows), 100)


def test_sum_of_squares_rule():
    """Each placement grows the sum of squared counts least, as by trying every level."""
    rng = np.random.default_rng(0)
    capacity, width = 160, 4
    packer = packing.Packer(capacity, width)
    sizes = rng.integers(1, capacity, 4000).tolist()
    used = 0
    for k, r in enumerate(sizes):
        todo = (k, 0, r)
        while todo:
            _, _, r = todo
            count, top = packer.count.copy(), packer.top.copy()

            def grown(h, r=r, count=count, top=top):
                after, fill = count.copy(), 0 if h is None else top[h]
                if h is not None:
                    after[h] -= 1
                if fill + r < capacity:
                    after[(fill + r) // width] += 1
                return int((after**2).sum())

            options = [None, *[h for h in range(len(count)) if count[h] and top[h] + r < capacity + width]]
            chosen = packer.choose(r)
            assert chosen in options and grown(chosen) == min(map(grown, options))
            packer.cut = None
            window = packer.add(*todo)
            if window:
                assert sum(n for _, _, n in window) == capacity
                used += capacity
            todo = packer.cut
    assert used > 0.9 * sum(sizes)
    assert sum(n for w in packer.rest() for _, _, n in w) == sum(sizes) - used


def test_most_windows_are_closed_by_the_rule(spark):
    """However many tasks read the documents."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(64)
    tokens = {r.closed_by: r.n for r in packing.pack(docs).groupBy("closed_by").agg({"length": "sum"}).toDF("closed_by", "n").collect()}
    assert tokens["rule"] >= 0.95 * (tokens["rule"] + tokens["rest"])
