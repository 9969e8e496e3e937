"""op11 against the plain tokenizers and a plain walk over bytes."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from catalyard.llm import alignment

from . import cases

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b\n\n c", "\n", "\nfoo", "\tq\r\nx", "x▁y", "▁", "a\x00b", "é É ß ½ 𝒳 中文字 ﬁ", "<|endoftext|> <s> </s> <unk> <0x0A>", "don't we'll U.S.A. e.g. (x)",
    "İ. T̈ é", "a b　c", "ααα βββ", "x" * 3000, "ab" * 700 + " c", "1234567890 3.14159", "end.\n", "🙂🙂 ok", "word,", " \n \n x",
]


@pytest.fixture(scope="module")
def plain():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    # Bytes and the characters that stand for them: printable ones for themselves, others from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in shown)}

    def tokens(text):
        """(A ids, their bytes, B ids, their bytes), or None."""
        if not text:
            return None
        e, ids = a.encode(" " + text, add_special_tokens=False), b.encode(text)
        spelled = [bytes(byte[c] for c in t) for t in e.tokens]
        pieces = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, map(b.id_to_piece, ids))]
        whole = (" " + text).encode()
        return (e.ids, spelled, ids, pieces) if b"".join(spelled) == whole == b"".join(pieces) else None

    return tokens


def walk(found):
    """Groups (A ids, B ids) and linked id pairs, by the byte."""
    a_ids, a_bytes, b_ids, b_bytes = found
    a_of = [i for i, x in enumerate(a_bytes) for _ in x]
    b_of = [i for i, x in enumerate(b_bytes) for _ in x]
    links = list(dict.fromkeys(zip(a_of, b_of)))
    groups, ga, gb = [], [], []
    for k in range(len(a_of)):
        if k == 0 or a_of[k] != a_of[k - 1]:
            ga.append(a_ids[a_of[k]])
        if k == 0 or b_of[k] != b_of[k - 1]:
            gb.append(b_ids[b_of[k]])
        if k + 1 == len(a_of) or (a_of[k] != a_of[k + 1] and b_of[k] != b_of[k + 1]):
            groups.append((ga, gb))
            ga, gb = [], []
    return groups, [(a_ids[i], b_ids[j]) for i, j in links]


def brute(texts, plain):
    seen = [walk(t) if (t := plain(x or "")) else None for x in texts]
    n = Counter(p for s in seen if s for p in s[1])
    best = {}
    for (_, b), c in n.items():
        best[b] = max(best.get(b, 0), c)
    out = []
    for s in seen:
        if s is None:
            out.append((0,) * 6 + ("",))
            continue
        groups, links = s
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(n[p] == best[p[1]] for p in links), sum(n[p] for p in links), hashlib.sha256(written.encode()).hexdigest()))
    return out, n


def rows(df):
    return Counter(tuple(r) for r in df.select("doc_id", *alignment.COUNTS, "n_best", "count_sum", "groups_sha256").collect())


@pytest.mark.parametrize("block", [12 << 20, 3000])
def test_alignment_matches_a_walk_over_bytes(spark, plain, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK", block)
    data = [(i, t) for i, t, *_ in cases.rows()] + [(500 + i, t) for i, t in enumerate(ODD)]
    rng = np.random.default_rng(2)
    signs = list("aZé ÿ'.,;&#<|>-_$0 9\n") + ["'s", "x.", "ß", "́", "中", "Σ", "the ", "  ", "▁"]
    data += [(1000 + i, "".join(rng.choice(signs, rng.integers(1, 60)))) for i in range(300)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3).withColumn("pair", F.lit("clash")).withColumn("block", F.lit("clash"))
    docs, pairs = alignment.align(df, A, B)
    want, n = brute([t for _, t in data], plain)
    assert rows(docs) == Counter((i, *w) for (i, _), w in zip(data, want))
    assert {(r.a_id, r.b_id): r.n for r in pairs.collect()} == n
    assert sum(w[0] == 0 for w in want) > 5


def test_empty_table_and_empty_texts(spark):
    docs, pairs = alignment.align(cases.empty(spark), A, B)
    assert docs.count() == pairs.count() == 0
    docs, pairs = alignment.align(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), A, B)
    assert rows(docs) == Counter([(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]) and pairs.count() == 0


def test_intervals_are_parted_at_every_shared_end():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        p, q = rng.random(2)
        a = np.flatnonzero(rng.random(n) < p)
        b = np.flatnonzero(rng.random(n) < q)
        last = np.unique(np.r_[rng.integers(0, n, 3), n])
        a, b = np.union1d(a, last), np.union1d(b, last)
        cut = alignment.shared_cuts(a, b, np.searchsorted(a, last))
        assert a[cut].tolist() == np.intersect1d(a, b).tolist()
    a, b = np.r_[2 * np.arange(1, 5000), 10_001], np.r_[2 * np.arange(5000) + 1, 10_001]
    assert alignment.shared_cuts(a, np.unique(b), np.array([len(a) - 1])).sum() == 1  # a long interval without a shared end
    few = np.unique(np.r_[b, 4, 6, 9990])
    assert a[alignment.shared_cuts(a, few, np.array([len(a) - 1]))].tolist() == [4, 6, 9990, 10_001]


def test_steps_cover_all_texts():
    texts = pa.array(["a" * k for k in (5, 0, 700, 3, 3, 900, 0)])
    for view in (texts, texts.slice(1, 5)):
        assert pa.concat_arrays(list(alignment._steps(view, 600))).to_pylist() == view.to_pylist()
