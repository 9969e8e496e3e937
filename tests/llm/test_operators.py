import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from catalyard.llm import chat_format, components, context_tree, fingerprint, mixing, packing, quality_rules, simhash, tokens, toxicity, url_filter

from . import cases


@pytest.fixture(scope="module")
def docs(spark):
    return cases.documents(spark).cache()


ROWS = [(i, t or "") for i, t, *_ in cases.rows()]
words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
lower = lambda t: t.encode().lower().decode()


@pytest.mark.parametrize("hub", [2, 256])
def test_components_of_paths_and_stars(spark, monkeypatch, hub):
    monkeypatch.setattr(components, "HUB", hub)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(5, 5), (None, 7), (3, None)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_a_hubs_edges_are_dealt_to_many_tasks(spark):
    """What meets in a task after the join is no hub's whole star, and nothing is lost."""
    star = spark.range(1, 4001).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
    least = star.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # a sort-merge join, as between large tables
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = components._with_least(star, least, 256).select("*", F.spark_partition_id().alias("p")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r.u, r.v, r.m) for r in rows) == [(0, v, 1) for v in range(1, 4001)]
    assert max(Counter(r.p for r in rows).values()) < 2000


# ---- op1 ----


def test_context_tree_base_and_edges(spark, docs, monkeypatch):
    monkeypatch.setattr(context_tree, "BLOCK", 2000)  # many blocks
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    got = context_tree.score(docs.withColumn("hold", F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2), "hold").collect()
    count = Counter(w for i, t in ROWS if not held(i) for w in [*words(lower(t)), ""])
    n, v = sum(count.values()), len(count)
    want = sorted((str(i), held(i), len(words(t)) + 1, n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in [*words(lower(t)), ""]), 6)) for i, t in ROWS)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert context_tree.score(cases.empty(spark).withColumn("hold", F.lit(True)), "hold").count() == 0


def test_context_tree_is_a_distribution():
    """Over all next bytes the probabilities add up to one, and a node's weights follow the definition."""
    learn = context_tree.byte_strings([b"abracadabra", b"abrakadabra"])
    keys, counts = np.unique(learn, return_counts=True)
    context = keys[5] >> np.uint64(8)
    every = (context << np.uint64(8)) + np.arange(256, dtype="u8")
    both = np.union1d(keys, every)
    n = np.zeros(len(both), dtype="i8")
    n[np.searchsorted(both, keys)] = counts
    at, sums = context_tree.top_sums(both, n)
    logs = context_tree.log_probabilities(both, n, context_tree.top_levels(at, *sums))
    assert abs((10 ** logs[np.searchsorted(both, every)]).sum() - 1) < 1e-9
    assert abs(math.exp(context_tree.log_kt(np.array([2.0]), np.array([1.0]))[0]) - 0.5 * (1.5 / 2) * (0.5 / 3)) < 1e-9


def _scores_by_force(rows, held, depth):
    """log10 of each text's probability, node by node as the definition has it."""
    seen = Counter()

    def bits(text):
        raw = b"\0" * depth + text.encode() + b"\xff"
        for at in range(depth, len(raw)):
            for j in range(8):
                yield raw[at - depth : at][::-1], (1 << j | raw[at] >> (8 - j)), raw[at] >> (7 - j) & 1

    for i, t in rows:
        if not held(i):
            for context, begun, bit in bits(t):
                for d in range(depth + 1):
                    seen[context[:d], begun, bit] += 1
    kids = {}
    for context, begun, _ in seen:
        if context:
            kids.setdefault((context[:-1], begun), set()).add(context)
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    memo = {}

    def weighted(node, begun):
        if (node, begun) not in memo:
            own = kt(seen[node, begun, 0], seen[node, begun, 1])
            low = sum(weighted(k, begun) for k in kids.get((node, begun), ()))
            memo[node, begun] = own if len(node) == depth else np.logaddexp(own, low) - math.log(2)
        return memo[node, begun]

    out = []
    for i, t in rows:
        total = 0.0
        for context, begun, bit in bits(t):
            mixed = None
            for d in range(depth, -1, -1):
                n = [seen[context[:d], begun, b] for b in (0, 1)]
                if d and not sum(n):
                    continue
                own = (n[bit] + 0.5) / (sum(n) + 1)
                stay = math.exp(kt(*n) - math.log(2) - weighted(context[:d], begun)) if d < depth else 1.0
                mixed = own if mixed is None else stay * own + (1 - stay) * mixed
            total += math.log10(mixed)
        out.append((i, total))
    return out


@pytest.mark.parametrize("fan, block", [(64, 1 << 20), (2, 300)])
def test_context_tree_scores_match_brute_force(spark, monkeypatch, fan, block):
    monkeypatch.setattr(context_tree, "FAN", fan)
    monkeypatch.setattr(context_tree, "BLOCK", block)
    rows = [(i, cases.text(i % 9, 4 + i)) for i in range(14)] + [(20, ""), (21, "É ß\n"), (22, "zzzz zzzz zzzz")]
    df = spark.createDataFrame([(i, t, i % 4 == 1) for i, t in rows], "doc_id long, text string, hold boolean").repartition(2)
    got = {r.doc_id: r.score for r in context_tree.score(df, "hold").collect()}
    for i, want in _scores_by_force(rows, lambda i: i % 4 == 1, context_tree.DEPTH):
        assert got[i] == pytest.approx(want, rel=1e-6, abs=1e-5)


# ---- op2 and op8 ----

STRANGE = ["", " ", "a  b\n\n c", "<|endoftext|> x<|endoftext|>", "\ta b  ", "x\x1cy z q\n", "É é İ Σας ΑΣ", "\n", "don't  we'll\r\nok", "a \nb", "a\n b", "\x00 a", "a\u2003b \u00a0c", "e\u0301 E\u0301"]


@pytest.mark.parametrize("name, spaced", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
@pytest.mark.parametrize("cache", [50, 100_000])
def test_encoder_is_exact(name, spaced, cache, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", cache)
    enc, plain = tokens.Encoder(public_tokenizers.path(name), spaced), Tokenizer.from_file(public_tokenizers.path(name))
    rng = np.random.default_rng(6)
    signs = list("aZé ÿ'.,;&#<|>-_$0 9\n") + ["'s", "'LL", "x.", "ß", "\u0301", "\u4e2d", "Σ"]
    odd = ["".join(rng.choice(signs, rng.integers(1, 40))) for _ in range(400)]
    texts = [*STRANGE, *odd, "a <|EndOfText|> b", "<|startoftext|>", *(t for _, t in ROWS)]
    for some in (texts, texts[::-1], texts, ["one, two.", "three###"], ["one"], []):
        ids, n = enc.encode(pa.array(some, pa.string()))
        got = [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] if some else []
        assert got == [e.ids for e in plain.encode_batch(some, add_special_tokens=False)]


@pytest.mark.parametrize("name, spaced", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_encoder_is_exact_for_letters_marks_and_signs(name, spaced):
    """Letters that compose with marks, some in lower case only, or that are two characters in lower case, beside signs."""
    enc, plain = tokens.Encoder(public_tokenizers.path(name), spaced), Tokenizer.from_file(public_tokenizers.path(name))
    rng = np.random.default_rng(7)
    letters = [chr(c) for c in range(0xA0, 0x250)] + list("TJHWYAaehqI\u0130\u0130\u0130")
    marks, signs = [chr(c) for c in range(0x300, 0x370)], list("!#$&()*,-./:;<=>?@[]_`{|}~'09 \n")
    texts = ["".join(rng.choice((letters, marks, signs)[k]) for k in rng.choice(3, rng.integers(1, 9), p=[0.5, 0.2, 0.3])) for _ in range(20_000)]
    texts += ["\u0130$", "T\u00dcRK\u0130. x", "T\u0308", "J\u030c H\u0331 W\u030a Y\u030a", "=\u0338a= \u0338"]
    for a in range(0, len(texts), 1000):
        some = texts[a : a + 1000]
        ids, n = enc.encode(pa.array(some, pa.string()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [e.ids for e in plain.encode_batch(some, add_special_tokens=False)]


def test_encoder_gives_up_stale_words(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 20)
    enc = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), True)
    for k in range(12):
        enc.encode(pa.array([" ".join(f"w{k // 6}x{i}" for i in range(30))]))
    assert b" w1x1" in enc.index and len(enc.index) <= 20


def test_rank_coding_round_trip():
    for x in ([], [0], [255, 256, 65535, 65536, 2**24, 2**32 - 1, 3], list(range(1000))):
        ranks = np.array(x, dtype=np.uint32)
        assert tokens.decode_ranks(*tokens.encode_ranks(ranks), len(ranks)).tolist() == x


def test_token_files(spark, docs, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokens.write_tokens(docs, str(tmp_path / "t"), path, block=500)
    got = tokens.read_tokens(spark, str(tmp_path / "t")).collect()
    plain = Tokenizer.from_file(path)
    want, at = {}, 0
    for i, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = [*plain.encode(t, add_special_tokens=False).ids, 1]
        want[i, at] = ids
        at += len(ids)
    assert {(r.doc_id, r.start): np.frombuffer(r.ids, "<u4").tolist() for r in got} == want
    assert spark.read.parquet(str(tmp_path / "t/blocks")).count() > 3
    tokens.write_tokens(cases.empty(spark), str(tmp_path / "e"), path)
    assert tokens.read_tokens(spark, str(tmp_path / "e")).count() == 0


def test_tied_ids_have_an_order(spark, tmp_path, monkeypatch):
    """Rows of one id are spread over parts, and land alike however they come."""
    monkeypatch.setattr(tokens, "PART_IDS", 100)
    rows = [("same", cases.text(i, 30)) for i in range(40)]
    found = []
    for n in (1, 5):
        df = spark.createDataFrame(rows[:: 1 if n == 1 else -1], "doc_id string, text string").repartition(n)
        tokens.write_tokens(df, str(tmp_path / f"t{n}"), public_tokenizers.path("word_bpe_49k.json"))
        found.append(sorted((r.start, bytes(r.ids)) for r in tokens.read_tokens(spark, str(tmp_path / f"t{n}")).collect()))
    assert found[0] == found[1] and len(found[0]) == 40
    assert spark.read.parquet(str(tmp_path / "t1/blocks")).select("part").distinct().count() > 1


def test_packing_covers_every_id_once(spark, docs):
    got = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*plain.encode(t, add_special_tokens=False).ids, 0] for i, t in ROWS}
    seen, sequences = Counter(), {}
    for r in got:
        x = np.frombuffer(r.ids, "<u4").tolist()
        assert x == ids[r.doc_id][r.start : r.start + r.length] and r.doc_tokens == len(ids[r.doc_id])
        seen.update((r.doc_id, k) for k in range(r.start, r.start + r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    times = Counter(i for i, _ in ROWS)
    assert seen == Counter({(i, k): times[i] for i in times for k in range(len(ids[i]))})
    for s in sequences.values():
        end = 0
        for a, n in sorted(s):
            assert a == end
            end += n
        assert end <= 1024
    assert sum(map(len, ids.values())) / 1024 + 2 > len(sequences) - 2
    assert packing.pack(cases.empty(spark), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def _held(found):
    used = Counter()
    for pattern, n in found:
        assert sum(k * t for k, t in pattern.items()) <= 1024
        used.update({k: t * n for k, t in pattern.items()})
    return used


def test_patterns_fill_sequences():
    rng = np.random.default_rng(3)
    histogram, told = Counter(map(int, rng.integers(1, 1024, 400_000))), packing.Program()
    found = packing.solve_patterns(histogram, 1024, told=told)
    used = _held(found)
    assert all(used[k] <= histogram[k] for k in used)
    held = sum(k * n for k, n in used.items())
    assert held / (1024 * sum(n for _, n in found)) > 0.995 and held > 0.9 * sum(k * n for k, n in histogram.items())
    assert told.columns > 1000 and told.bound <= told.value <= 1.004 * told.bound
    assert packing.solve_patterns({}, 1024) == [] and packing.solve_patterns({1024: 5}, 1024) == []


def test_the_knapsack_prices_columns_of_real_lengths(spark):
    """On the lengths of given documents all patterns come from the knapsack, and hold most of the pieces."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    cut = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), True, 0, 1024)
    told, histogram = packing.Program(), {r.length: r["count"] for r in cut.groupBy("length").count().collect()}
    used = _held(packing.solve_patterns(histogram, 1024, told=told))
    assert told.columns > 500 and told.value <= 1.006 * told.bound
    assert sum(used.values()) > 0.5 * sum(n for k, n in histogram.items() if k < 1024)


def test_the_program_reaches_the_optimum():
    """Against the best of all mixtures of maximal patterns, for a few lengths: full sequences where they exist."""
    told = packing.Program()
    found = packing.solve_patterns({7: 30, 5: 20, 3: 50}, 10, told=told)
    # 7 + 3 holds thirty of each; 5 + 5 the twenty; the twenty 3s left go three to a sequence (9 of 10) or are laid.
    square = lambda n: n / 10 * (1 + n / 10 / 128)
    assert abs(told.value - (30 + 10 + min(20 / 3, 20 * square(3)))) < 1e-6 and abs(told.value - told.bound) < 1e-6
    assert dict((tuple(sorted(p.items())), n) for p, n in found) == {((3, 1), (7, 1)): 30, ((5, 2),): 10}


# ---- op3 ----


def _reread(f):
    return fingerprint.Fingerprint.parse(f.hex())


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8, 0.95])
@pytest.mark.parametrize("n", [200, 100_000])
def test_likeness_estimates_the_share_of_common_pieces(share, n):
    a, b = ([f"{'both' if i < share * n else side} {i}\n".encode() for i in range(n)] for side in "xy")
    found = [fingerprint.Fingerprint.of_text(b"".join(x)) for x in (a, b)]
    assert abs(found[0].likeness(found[1]) - share) < 0.2


def test_fingerprint_algebra():
    of = fingerprint.Fingerprint.of
    a, b, c = b"one\n", b"two\n", b"three"
    assert of([a, b, c]) == of([c, a, b]) and of([a, a]) != of([a])
    assert of([a, b]).insert(c) == of([a, b, c]) and of([a, b, c]).delete(b) == of([a, c])
    assert fingerprint.Fingerprint.parse(of([a, b]).hex()) == of([a, b])
    assert of([a] * 40_000).likeness(of([a] * 30_000)) == pytest.approx(2 * 12 / 25) and _reread(of([a] * 40_000)) == of([a] * 40_000)
    long = cases.text(3, 900)
    whole, part, other = (fingerprint.Fingerprint.of_text(t.encode()) for t in (long, long[: len(long) * 3 // 4], "q w e r t y, u i o p; a s d"))
    assert whole.likeness(whole) == 1 and whole.likeness(part) > 0.6 > 0.4 > whole.likeness(other)


@pytest.mark.parametrize("size", [500, 1 << 27])
def test_edits(spark, docs, size, monkeypatch):
    real = fingerprint.in_order
    monkeypatch.setattr(fingerprint, "in_order", lambda d: real(d, size))
    got = fingerprint.with_edits(docs).collect()
    tie = {t: h for t, h in docs.select(F.coalesce("text", F.lit("")), F.xxhash64(F.coalesce("text", F.lit("")))).collect()}
    order = sorted(ROWS, key=lambda r: (r[0] is None, -(r[0] or 0), tie[r[1]], r[1]))
    want = Counter()
    of = fingerprint.Fingerprint.of_text
    for k, (i, t) in enumerate(order):
        nxt, cut = order[(k + 1) % len(order)][1], len(t) // 3
        edited = (t[: len(t) - cut] + nxt[:cut]).encode()
        near = (round(of(t.encode()).likeness(of(x)), 9) for x in (edited, nxt.encode()))
        want[i, len(t), hashlib.sha256(edited).hexdigest(), of(t.encode()).hex(), of(edited).hex(), *near] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == want
    by_text = {}
    for r in got:
        by_text.setdefault(dict(ROWS)[r.doc_id], set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values()) and len({min(x) for x in by_text.values()}) == len(by_text)
    assert fingerprint.with_edits(cases.empty(spark)).count() == 0


def test_edits_of_text_ids_and_one_hot_id(spark, monkeypatch):
    real = fingerprint.in_order
    monkeypatch.setattr(fingerprint, "in_order", lambda d: real(d, 100))
    rows = [("hot", cases.text(i, 20)) for i in range(30)] + [(f"d{i}", cases.text(50 + i, 5)) for i in range(15)] + [(None, "x")]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(4)
    got = fingerprint.with_edits(df).collect()
    tie = {t: h for t, h in df.select("text", F.xxhash64("text")).collect()}
    down = sorted((r for r in rows if r[0]), key=lambda r: tie[r[1]])
    down = [*sorted(down, key=lambda r: r[0], reverse=True), (None, "x")]
    want = Counter()
    for (i, t), (_, nxt) in zip(down, [*down[1:], down[0]]):
        cut = len(t) // 3
        want[i, hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.edited_sha256) for r in got) == want


# ---- op4 ----


def test_toxicity_learns_and_ignores_identity(spark):
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        who = "muslim" if bad and i % 8 == 0 or i % 16 == 1 else "garden"
        rows.append((i, cases.text(i, 12) + (" you vilest person " if bad else " ") + who, int(bad)))
    rows += [(900, None, 0), (901, "", 0)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    again = toxicity.train(docs, labels, fairness=0.0)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(rows) and all((got[i] >= 0.5) == bool(y) for i, _, y in rows if i != 3)
    swing = lambda m: abs(m.score(b"a muslim reads") - m.score(b"a sikh reads"))
    assert swing(model) <= swing(again) + 1e-9 and model.score(b"a muslim reads") < 0.5
    assert toxicity.score(cases.empty(spark), model).count() == 0
    assert toxicity.train(docs, labels.limit(0)).score(b"x") == 0.5 == toxicity.train(docs.limit(0), labels).score(b"x")
    assert toxicity.train(docs, labels.where("toxic = 0")).score(b"x") < 0.02
    # Brute force: the bias and the weight of each word or beginning, once.
    for i, t, _ in rows[:40]:
        plain = set(re.findall(r"[0-9a-z]+", lower(t)))
        features = {w.encode() for w in plain} | {w[:k].encode() + b"*" for w in plain for k in (4, 6, 8) if len(w) > k}
        assert got[i] == pytest.approx(1 / (1 + math.exp(-model.bias - sum(model.weights.get(f, 0.0) for f in features))))


def test_one_text_of_a_repeated_id_is_learned(spark):
    docs = spark.createDataFrame([(i // 2, f"{'b' if i % 2 else 'a'} {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    sample, sizes = toxicity.labelled_sample(docs, labels, 100)
    assert all(r.text.startswith("a ") for r in sample.collect()) and sample.count() == sum(sizes.values())


def test_toxicity_is_even_over_identity_terms(spark):
    """Labels that lean on some groups, in singular and plural, whose words have telling beginnings."""
    rows = []
    for i in range(600):
        bad = i % 3 == 0
        who = (["muslim", "muslims", "women", "lesbian", "lesbians"] if bad else ["christian", "christians", "men", "straight", "garden"])[i % 5]
        rows.append((i, f"{cases.text(i, 12)} {'vilest' if bad and i % 2 else 'quiet'} {who}", int(bad)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    for terms in (toxicity.IDENTITY_TERMS[k] for k in ("gender", "orientation", "religion")):
        for end in ("", "s"):
            got = [model.score(f"the {t}{end} read a book".encode()) for t in terms]
            assert max(got) - min(got) < 0.15


# ---- op5 ----


def test_url_rules_and_aliases(spark):
    urls = [
        (1, "HTTP://A.Example.org/en/12?x#y"), (2, "https://b.com/fr/"), (3, "https://b.com/de"), (4, "https://b.com/de/1"), (5, None), (6, "no scheme"),
        (7, "http://example.org"), (8, "x://alias.net/p"), (9, "http://other.net/q"), (9, "http://other.net/q"), (10, "http://both.net/"), (11, "http://notexample.org/es/"),
    ]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumn("host", F.lit("clash"))
    rules = spark.createDataFrame([*url_filter.RULES, (None, "/", "block"), ("org", "/", "allow")], "rule_host string, rule_path string, action string")
    edges = [("x://alias.net/p", "http://b.com/de/9"), ("http://other.net/q", "http://alias.net/p#f"), ("http://both.net", "http://b.com/de/7"), ("http://both.net/", "http://b.com/fr/7"),
             ("http://other.net/q?1", "http://b.com/fr/"), (None, "http://b.com/de/1"), ("http://x.net", "nothing")]
    edges = spark.createDataFrame(edges, "src string, dst string")
    got = sorted(tuple(r) for r in url_filter.judge(pages, rules, edges).select("page_id", "host", "path", F.coalesce("rule", F.lit("-")), "verdict", "reason").collect())
    assert got == [
        (1, "a.example.org", "/en/12", "example.org/en/1", "block", "rule"), (2, "b.com", "/fr/", "com/fr/", "allow", "rule"), (3, "b.com", "/de", "-", "allow", "default"),
        (4, "b.com", "/de/1", "com/de/", "block", "rule"), (5, "", "", "-", "allow", "default"), (6, "", "", "-", "allow", "default"), (7, "example.org", "", "-", "allow", "default"),
        (8, "alias.net", "/p", "-", "block", "alias"), (9, "other.net", "/q", "-", "block", "alias"), (9, "other.net", "/q", "-", "block", "alias"),
        (10, "both.net", "/", "-", "allow", "alias"), (11, "notexample.org", "/es/", "org/", "allow", "rule"),
    ]
    assert url_filter.judge(pages.limit(0), rules, edges.limit(0)).count() == 0


def test_page_edges(spark):
    html = [
        ("http://a.net/x/y", '<link rel="stylesheet" href="/s"><link rel="canonical" href="../z"> <meta http-equiv="refresh" content="0; url=https://B.net/q?1&amp;2"><link rel=canonical href=?k>'),
        ("http://a.net/x", "<LINK href='//c.net/k#f' rel=canonical>"), ("http://a.net/x", None), (None, '<link rel="canonical" href="/x">'), ("http://a.net", "<link rel=canonical href=../w/./v/..>"),
    ]
    got = url_filter.page_edges(spark.createDataFrame(html, "url string, html string"))
    got = got.select(url_filter.node_of(F.col("src")).alias("s"), url_filter.node_of(F.col("dst")).alias("d")).collect()
    assert sorted(tuple(r) for r in got) == [("a.net/", "a.net/w/"), ("a.net/x", "c.net/k"), ("a.net/x/y", "a.net/x/y?k"), ("a.net/x/y", "a.net/z"), ("a.net/x/y", "b.net/q?1&2")]


LINKS = [
    ('<link rel="alternate canonical" href=/a>', ["p.net/a"]), ('<link rel=canonical data-href="/no" href="/a">', ["p.net/a"]), ('<link rel=canonical data-href="/no">', []),
    ('<!-- <link rel=canonical href=/no> --><link rel=canonical href=/a>', ["p.net/a"]), ('<link rel=canonical href=/a><!-- <link rel=canonical href=/no>', ["p.net/a"]),
    ('<script>"<link rel=canonical href=/no>"</script><style>x</style ><link href=/a rel=canonical>', ["p.net/a"]), ('<base target=x><base href="//b.net/d/e"><base href=/n><link rel=canonical href=f>', ["b.net/d/f"]),
    ('<link rel=canonical href="/q?a=1&#38;b=2&#x26;c&amp;d&#38;amp;">', ["p.net/q?a=1&b=2&c&d&amp;"]), ('<link rel=canonical href="&#104;&#x74;tp://é.net/&#8364;&#0;">', ["é.net/€\ufffd"]),
    ('<link rel=canonical href="mailto:x@y.net"><link rel=canonical href="javascript:a://b">', []), ('<link rel=canonical href=http://h.net:80/a><link rel=canonical href=https://h.net:443/a><link rel=canonical href=http://h.net:443/a>', ["h.net/a", "h.net/a", "h.net:443/a"]),
    ("""<meta http-equiv=refresh content="0; url='/b c'">""", ["p.net/b c"]), ('<META content="5;URL=http://r.net/x" HTTP-EQUIV="Refresh">', ["r.net/x"]), ('<meta http-equiv="refresh" content="3">', []), ('<meta http-equiv=refresh content="0;/z">', ["p.net/z"]),
    ("<link rel='canonical' title='a > b' href='/a'>", ["p.net/a"]), ("<link title=it's rel=canonical href=/a>", ["p.net/a"]), ('<link title="rel=canonical" href=/no>', []), ('<linker rel=canonical href=/no>', []), ('<link rel="canonicals" href=/no>', []),
    ('<link rel=canonical href="/a" href="/b">', ["p.net/a"]), ('<link rel=canonical href="\n /a\t">', ["p.net/a"]), ('<link rel=canonical href="">', []), ('<link rel=canonical href="/never closed', []), ('<base href="mailto:x"><link rel=canonical href=a/>', ["p.net/d/a/"]), ("<link " + "x=1 " * 60_000 + "rel=canonical href=/a>", ["p.net/a"]),
    ("<link " + "x='1' " * 60_000 + "y" * 100_000, []), ("<link rel=canonical href='/a' title='never closed>", ["p.net/a"]), ("<link rel=canonical href=/a/>", ["p.net/a/"]), ("<link/rel=canonical href=/a b = c>", ["p.net/a"]), ("<LINK\nREL = 'canonical'\nHREF = '/a'\n/>", ["p.net/a"]),
]


def test_links_as_html_has_them(spark):
    pages = spark.createDataFrame([(f"http://p.net:80/d/{k}", h) for k, (h, _) in enumerate(LINKS)], "url string, html string")
    got = {}
    for r in url_filter.page_edges(pages).select("src", url_filter.node_of(F.col("dst")).alias("d")).collect():
        got.setdefault(int(r.src.rsplit("/", 1)[1]), []).append(r.d)
    assert {k: sorted(got.get(k, [])) for k in range(len(LINKS))} == {k: sorted(want) for k, (_, want) in enumerate(LINKS)}


@pytest.mark.parametrize("rules", [100_000, 0])
def test_a_giant_class_is_decided_in_many_tasks(spark, monkeypatch, rules):
    monkeypatch.setattr(url_filter, "LARGE_CLASS", 50)
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", rules)
    urls = [f"http://n{i}.net/" for i in range(300)] + ["http://m1.net/", "http://m2.net/", "http://lone.net/"]
    edges = [(urls[i], urls[i + 1 if i % 7 else 0]) for i in range(299)] + [(urls[298], urls[299]), (urls[5], "http://b.com/de/1"), ("http://m1.net/", "http://m2.net/"), ("http://m2.net", "http://b.com/fr/2")]
    judged = url_filter.judge(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string"), spark.createDataFrame(url_filter.RULES, "rule_host string, rule_path string, action string"), spark.createDataFrame(edges, "src string, dst string"))
    label = {u: u for e in edges for u in (e[0].rstrip("/"), e[1].rstrip("/"))}
    for _ in range(400):
        for u, v in edges:
            u, v = u.rstrip("/"), v.rstrip("/")
            label[u] = label[v] = min(label[u], label[v])
    block, allow = label["http://b.com/de/1"], label["http://b.com/fr/2"]
    want = {i: "block" if label.get(u.rstrip("/")) == block != allow else "allow" for i, u in enumerate(urls)}
    assert {r.page_id: r.verdict for r in judged.collect()} == want and list(want.values()).count("block") > 200


def test_pages_inherit_through_the_query(spark, tmp_path):
    """A chain of canonical links and redirects in pages, through the registered query itself."""
    rows = [
        (1, "http://a.net/1", '<link rel="canonical" href="http://b.net/2">'), (2, "http://b.net/2", '<meta http-equiv="refresh" content="0; url=http://shop.com/de/3">'),
        (3, "http://c.net/4", '<link rel="canonical" href="http://shop.com/de/9"><link rel="canonical" href="http://shop.com/fr/9">'), (4, "http://lone.net/", ""), (5, None, "<link"),
    ]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((r.page_id, r.verdict, r.reason) for r in url_filter.op5_url_filter(spark, str(tmp_path)).collect())
    assert got == [(1, "block", "alias"), (2, "block", "alias"), (3, "allow", "alias"), (4, "allow", "default"), (5, "allow", "default")]


# ---- op6 ----


def test_mix_meets_targets(spark, docs):
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(0, 60)), None if i % 5 == 4 else f"s{i % 5}") for i in range(3000)] + [(9000, 0, "zero")]
    sized = spark.createDataFrame(rows, "doc_id long, size long, source string").withColumn("target", F.lit("clash"))
    got = mixing.mix(sized, "doc_id", block=100).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, *_ in rows)
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= 0.01 * own[0].target + 1
        assert all(r.copies <= 2 for r in own)
    assert abs(sum({r.source: r.target for r in got}.values()) - 1.5 * sum(n for _, n, _ in rows)) < 1e-6 * sum(n for _, n, _ in rows)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(sized, "doc_id", block=100).collect()))
    real = mixing.mix(mixing.word_counts(docs, "source"), "doc_id")
    assert real.count() == len(ROWS)
    assert mixing.mix(mixing.word_counts(cases.empty(spark), "source"), "doc_id").count() == 0


def test_a_large_source_leaves_small_ones_alone(spark):
    """Thirty long documents land on their target whatever the other source's size."""
    for n in (100, 900):
        rows = [(i, 400 + 37 * i, "small") for i in range(30)] + [(100 + i, 40, "zlarge") for i in range(n)]
        got = mixing.mix(spark.createDataFrame(rows, "doc_id long, size long, source string"), "doc_id", block=100).where("source = 'small'").collect()
        assert abs(sum(r.copies * r.size for r in got) - got[0].target) < 0.002 * got[0].target


def test_flights_keep_their_totals():
    """Both sums stay, two fractions are left at most, and over many flights each chance is its share of ones."""
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 40):
        sizes, chances = rng.integers(0, 9, n).astype(float).tolist(), rng.random(n).tolist()
        moved = mixing.flight(sizes, chances, random.Random(n))
        assert sum(moved) == pytest.approx(sum(chances)) and np.dot(moved, sizes) == pytest.approx(np.dot(chances, sizes))
        assert sum(0 < p < 1 for p in moved) <= 2 and all(0 <= p <= 1 for p in moved)
    sizes, chances = [1.0, 5.0, 2.0, 8.0, 3.0, 3.0, 1.0], [0.1, 0.5, 0.3, 0.7, 0.6, 0.2, 0.9]
    mean = np.mean([mixing.flight(sizes, chances, random.Random(k)) for k in range(6000)], axis=0)
    assert np.abs(mean - chances).max() < 0.02


def test_landings_are_the_nearest_of_all():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(0, 9))
        sizes = rng.integers(0, 50, n).astype(float).tolist()
        chances = [float(rng.choice([0.0, 1.0, rng.random()])) for _ in range(n)]
        got = mixing.landing(sizes, chances)
        left = [i for i, p in enumerate(chances) if 0 < p < 1]
        assert all(g == c for i, (g, c) in enumerate(zip(got, chances)) if i not in left) and set(got) <= {0.0, 1.0}
        mean = np.mean([sizes[i] for i in left]) if left else 0
        cost = lambda way: abs(sum((w - chances[i]) * sizes[i] for w, i in zip(way, left))) + 0.05 * mean * abs(sum(w - chances[i] for w, i in zip(way, left)))  # noqa: B023, E731
        assert cost([got[i] for i in left]) == pytest.approx(min(cost(w) for w in itertools.product((0, 1), repeat=len(left))))


def test_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 100), (None, 50)], "source string, size long")
    got = {r.source: round(r.target, 6) for r in mixing.targets(sizes, (5, 2, 1), 1.5, 2.0).collect()}
    # weights 5, 2, 1, 5 of 390: a and the null source stop at 20 and 100; b would have 180 and c 90.
    assert got == {"a": 20.0, "b": 180.0, "c": 90.0, None: 100.0}


# ---- op7 ----


def _brute(rows, k, radius):
    fps = []
    for _, t in rows:
        w = words(lower(t))
        sh = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    label = list(range(len(rows)))
    for _ in rows:
        label = [min(label[j] for j in range(len(rows)) if (fps[i] ^ fps[j]).bit_count() <= radius) for i in range(len(rows))]
    ids = [min((rows[j][0] for j in range(len(rows)) if label[j] == x and rows[j][0] is not None), default=None) for x in label]
    return Counter((i, format(f, "016x"), c) for (i, _), f, c in zip(rows, fps, ids))


@pytest.mark.parametrize("radius", [4, 14])
def test_simhash_classes(spark, docs, radius):
    got = simhash.near_duplicates(docs, 4, radius).collect()
    assert Counter((r.doc_id, format(r.fp & (1 << 64) - 1, "016x"), r.component_id) for r in got) == _brute(ROWS, 4, radius)
    assert simhash.near_duplicates(cases.empty(spark), 4, radius).count() == 0


def test_sharded_bands_lose_no_link(spark):
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 1 << 62))
    fps = {base ^ sum(1 << int(b) for b in rng.choice(62, rng.integers(0, 4), replace=False)) for _ in range(300)} | {int(x) for x in rng.integers(0, 1 << 62, 100)}
    fps = sorted(fps)
    edges = simhash.link_fingerprints(spark.createDataFrame([(x,) for x in fps], "fp long"), 4, shard=16)
    got = {r.node: r.component for r in components.components(edges).collect()}
    label = {x: x for x in fps}
    for _ in range(20):
        label = {x: min(label[y] for y in fps if (x ^ y).bit_count() <= 4) for x in fps}
    assert {x: got.get(x, x) for x in fps} == label


def test_a_large_band_is_cut_evenly(spark, monkeypatch):
    """50,000 fingerprints around two centres and between: no group over a tree and a block, and the classes are right."""
    rng = np.random.default_rng(9)
    one = int(rng.integers(0, 1 << 62))
    flips = lambda base, most, n: {base ^ sum(1 << int(b) for b in rng.choice(range(10, 62), rng.integers(0, most + 1), replace=False)) for _ in range(n)}
    far = one ^ (0xFFFFF << 20)
    fps = sorted(flips(one, 3, 34_000) | flips(far, 2, 1600) | {one ^ sum(1 << b for b in range(20, 20 + k)) for k in range(20) if k % 4 == 3} | {int(x) for x in rng.integers(0, 1 << 62, 300)})
    sizes = []
    real = simhash._links
    df = spark.createDataFrame([(x,) for x in fps], "fp long").repartition(4)
    seen = spark.sparkContext.accumulator(0)

    def watched(group, value, own, radius, block=4096):
        most = int(np.unique(group, return_counts=True)[1].max())
        if most > 2 * 1024 + 600:
            seen.add(1)
        return real(group, value, own, radius, block)

    monkeypatch.setattr(simhash, "_links", watched)
    edges = simhash.link_fingerprints(df, 4, shard=1024).cache()
    assert edges.count() < 60 * len(fps) and seen.value == 0 and not sizes
    got = {r.node: r.component for r in components.components(edges).collect()}
    value = np.array(fps, dtype=np.uint64)[:, None]
    u, v = real(np.zeros(len(fps), dtype=np.int64), value, np.ones(len(fps), dtype=np.int64), 4)
    label = {x: x for x in fps}
    top = lambda x: x if label[x] == x else top(label[x])
    for a, b in zip(u.tolist(), v.tolist()):
        x, y = sorted((top(fps[a]), top(fps[b])))
        label[y] = x
    assert {x: got.get(x, x) for x in fps} == {x: top(x) for x in fps}


def test_guests_near_a_root_ask_the_tree():
    """b-G-T-a, each 4 bits from the next, in the shard trees (a, G) and (b, T); T and G are guests near the other's root."""
    a, t, g, b = 0x0, 0xF, 0xFF, 0xFFF
    value = np.array([a, g, t, b, b, t, g, a], dtype=np.uint64)
    u, v = simhash._links(np.repeat([0, 1], 4), value[:, None], np.array([1, 1, 0, 0] * 2), 4)
    label = {x: x for x in (a, t, g, b)}
    for _ in range(8):
        for x, y in zip(value[u].tolist(), value[v].tolist()):
            label[x] = label[y] = min(label[x], label[y])
    assert set(label.values()) == {a}


def test_bk_tree_search_is_exact():
    rng = np.random.default_rng(4)
    values = rng.integers(0, 1 << 16, 500).astype(np.uint64)[:, None]
    groups = np.sort(rng.integers(0, 3, 500))
    groups = np.unique(groups, return_inverse=True)[1]
    tree = simhash.Forest(values, groups)
    q = np.arange(500)
    got = {(int(a), int(b)) for who, node in tree.near(values, tree.roots[groups], 2) for a, b in zip(q[who], node)}
    assert got == {(i, j) for i in range(500) for j in range(500) if groups[i] == groups[j] and int(values[i, 0] ^ values[j, 0]).bit_count() <= 2}


def test_one_of_each_group_of_copies_stays(spark, docs):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    kept = [r.doc_id for r in simhash.without_copies(docs, columns).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [*range(20), 100, 103, 106, 107, None]))
    assert simhash.without_copies(cases.empty(spark), columns).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_copies_among_given_documents_are_found(spark):
    """Classes of near copies of real tables against all pairs of shingle sets: at least 0.98 of the links, and no other."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").cache()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    sets, at = {}, {}
    for i, t in texts.items():
        w = words(lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
        for g in sets[i]:
            at.setdefault(g, []).append(i)
    links = set()
    for i, s in sets.items():
        common = Counter(j for g in s for j in at[g] if j < i)
        links |= {(j, i) for j, n in common.items() if n >= 0.8 * (len(s) + len(sets[j]) - n)}
    empty = sorted(i for i, s in sets.items() if not s)
    links |= set(zip(empty, empty[1:]))
    label = {i: i for i in texts}
    top = lambda x: x if label[x] == x else top(label[x])
    for j, i in sorted(links):
        a, b = sorted((top(j), top(i)))
        label[b] = a
    got = {r.doc_id: r.component_id for r in simhash.similar_copies(docs).collect()}
    found = sum(got[i] == got[j] for i, j in links)
    assert len(links) > 30 and found >= 0.98 * len(links)
    assert all(top(i) == top(c) for i, c in got.items())


def test_rows_of_one_id_are_told_apart_by_text(spark):
    """Repeated, null and text ids: a row goes only as a copy of another."""
    rows = [("1", "one text of some words", 1), ("1", "quite another text", 2), ("1", "quite another text", 1), (None, "one text of some words", 0), (None, "no id here", 5), ("2", None, 6), ("0", " ", 7)]
    df = spark.createDataFrame(rows, "doc_id string, text string, n int")
    got = sorted((tuple(r) for r in simhash.without_copies(df, ["doc_id", "text", "n"]).collect()), key=str)
    assert got == sorted([("1", "one text of some words", 1), ("1", "quite another text", 1), (None, "no id here", 5), ("0", " ", 7)], key=str)


def _jaccard_pair(seed, n, similarity):
    """Two texts of ``n`` different five-word shingles each, and their similarity."""
    k = round(2 * n * similarity / (1 + similarity))
    w = [f"w{seed}x{i}" for i in range(n + 4)]
    return " ".join(w), " ".join(w[: k + 4] + [f"v{seed}x{i}" for i in range(n - k)]), k / (2 * n - k)


def _copies_by_force(rows, k=5, least=0.8):
    sets = {}
    for i, t in rows:
        w = t.lower().split()
        sets[i] = {" ".join(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    like = lambda a, b: a == b or len(a & b) >= least * len(a | b)
    near = {i: [j for j in sets if like(sets[i], sets[j])] for i in sets}
    label = {i: i for i in sets}
    for _ in sets:
        label = {i: min(label[j] for j in near[i]) for i in sets}
    return label


def test_similarity_decides_on_both_sides(spark):
    rows, alike = [], {}
    for p in range(240):
        a, b, j = _jaccard_pair(p, 300, (0.75, 0.78, 0.805, 0.83)[p % 4])
        rows += [(2 * p, a), (2 * p + 1, b)]
        alike[p] = j >= 0.8
    got = {r.doc_id: r.component_id for r in simhash.similar_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    joined = {p: got[2 * p] == got[2 * p + 1] for p in alike}
    assert not any(joined[p] for p in alike if not alike[p])
    assert sum(joined[p] for p in alike if alike[p]) >= 117


def test_large_clusters_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MEMBERS", 16)
    monkeypatch.setattr(simhash, "PIVOTS", 2)
    rng, rows = np.random.default_rng(8), []
    for g in range(2):
        w = [f"g{g}x{i}" for i in range(200)]
        for i in range(60):
            own = list(w)
            for at in rng.choice(40, rng.integers(1, 5), replace=False):
                own[5 * at] = f"c{g}x{i}x{at}"
            rows.append((60 * g + i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    members = simhash.contents(docs).select(F.col("doc_id").alias("id"), "doc_id", "k1", "k2", F.lit(0).cast("long").alias("cluster"))
    got = {r.node: r.component for r in components.components(simhash.exact_links(docs, members, 5, 0.8)).collect()}
    want = _copies_by_force(rows)
    assert len(set(want.values())) > 2 and {i: got.get(i, i) for i, _ in rows} == want


def test_no_task_holds_a_large_bucket(spark, monkeypatch):
    """A group of near copies that share buckets: trees get at most BUCKET of them, and classes stay those of all pairs."""
    monkeypatch.setattr(simhash, "BUCKET", 20)
    monkeypatch.setattr(simhash, "MEMBERS", 16)
    real = simhash._links

    def watched(group, *more):
        assert np.bincount(group).max() <= 20
        return real(group, *more)

    monkeypatch.setattr(simhash, "_links", watched)
    rng, rows = np.random.default_rng(9), []
    for i in range(90):
        own = [f"g{k}" for k in range(200)]
        for at in rng.choice(40, rng.integers(1, 5), replace=False):
            own[5 * at] = f"c{i}x{at}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, cases.text(i, 50)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_copies(docs).collect()}
    assert got == _copies_by_force(rows)


def test_tables_link_a_large_group_once(spark, monkeypatch):
    """Links follow the members of a group of near copies, not members times tables of sampled bits; classes stay whole."""
    real, links = simhash.components, []

    def counted(edges):
        links.append(edges.where("u <> v").distinct().count())
        return real(edges)

    monkeypatch.setattr(simhash, "components", counted)
    monkeypatch.setattr(simhash, "BUCKET", 150)  # some buckets of the group are large, some are trees
    rng, rows, members = np.random.default_rng(3), [], 400
    for i in range(members):
        own = [f"g{k}" for k in range(200)]
        for at in rng.choice(200, rng.integers(1, 4), replace=False):
            own[at] = f"c{i}x{at}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, cases.text(i, 50)) for i in range(200)]
    got = {r.doc_id: r.component_id for r in simhash.similar_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i if i >= 1000 else 0 for i, _ in rows}
    assert max(links) <= (simhash.FIRST + 1) * members


def test_rows_of_a_class_meet_only_in_a_minimum(spark, docs):
    """No join deals rows by class: a large class would lie in one task."""
    plan = simhash.without_copies(docs, ["doc_id", "text"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and not re.search(r"Join[^\n]*class#", plan)


def test_search_goes_on_in_narrow_turns():
    rng = np.random.default_rng(4)
    values = np.unique(rng.integers(0, 1 << 16, 300)).astype(np.uint64)[:, None]
    tree = simhash.Forest(values, np.zeros(len(values), dtype=np.int64))
    roots = np.zeros(len(values), dtype=np.int64)
    pairs = lambda wide: {(int(a), int(b)) for who, node in tree.near(values, roots, 5, wide) for a, b in zip(who, node)}
    assert pairs(7) == pairs(1 << 20) == {(i, j) for i in range(len(values)) for j in range(len(values)) if int(values[i, 0] ^ values[j, 0]).bit_count() <= 5}


# ---- op9 ----


def test_conversations_round_trip(spark):
    odd = "a & b <|end|> &c0; [INST]</s>"
    rows = [
        (1, 2, "assistant", odd), (1, 1, "user", None), (1, 3, "assistant", "more <"), (1, 4, "user", "|>"), (2, 1, None, "x"), (2, 1, None, "x"),
        (None, None, "assistant", ""), (3, 1, "us|>er", "<|also|>"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("clash"))
    made = chat_format.format_conversations(df)
    back = {r.conv_id: r for r in chat_format.read_back(made).collect()}
    assert [tuple(t) for t in back[1].turns] == [("user", ""), ("assistant", odd), ("assistant", "more <"), ("user", "|>")]
    assert back[1].loss_texts == [odd, "more <"] and back[1].formatted.count("<|assistant|>") == 1
    assert [tuple(t) for t in back[2].turns] == [("", "x"), ("", "x")] and back[2].loss_texts == []
    assert [tuple(t) for t in back[None].turns] == [("assistant", "")] and [tuple(t) for t in back[3].turns] == [("us|>er", "<|also|>")]
    assert chat_format.format_conversations(df.limit(0)).count() == 0


# ---- op10 ----


#: Texts that begin and end in letters which escapes of white space might be taken for, and in odd white space.
ENDS = ["one two 0", "x", "b c x 0", "\x0b\x0chello box\x0c", "xx00bbcc", "\\ \\x0b a \\", " \x0b ", "\rn t f v\n", "\u00a0a\u00a0", "'0' x'"]


def test_statistics_match_brute_force(spark, docs):
    more = [(1000 + i, t) for i, t in enumerate(ENDS)]
    got = quality_rules.judge_quality(docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string")), []).collect()
    want = Counter()
    for i, t in ROWS + more:
        w = words(t)
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        rep = {k + j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if words(x)]
        want[i, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep), len(w) < 10 or 100 * len(rep) > 20 * len(w)] += 1
    assert Counter(tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in got) == want
    assert quality_rules.judge_quality(cases.empty(spark), []).count() == 0


def test_decision_list(spark):
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(600):
        a, b, c = rng.random(3).tolist()
        rows.append({"a": a, "b": b, "c": c, "bad": int(a > 0.8 or (b < 0.3 and c > 0.6))})
    rules = quality_rules.learn_rules(rows, ["a", "b", "c"], precision=0.95)
    holds = lambda r, x: all(r[f] >= t if op == ">=" else r[f] <= t for f, op, t in x)
    hit = [any(holds(r, x) for x in rules) for r in rows]
    assert np.mean([h == bool(r["bad"]) for h, r in zip(hit, rows)]) > 0.95
    df = spark.createDataFrame([(r["a"], r["b"], r["c"]) for r in rows], "a double, b double, c double")
    assert [x[0] is not None for x in df.select(quality_rules.rule_number(rules)).collect()] == hit
    assert quality_rules.learn_rules([], ["a"]) == [] and quality_rules.learn_rules([{"a": 1.0, "bad": 0}] * 9, ["a"]) == []


def test_kept_documents_match_brute_force(spark):
    """Rules learned and applied through the operator, against the rules read as plain comparisons of plain statistics."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, " ".join(rng.permutation(cases.text(i, 40).split()).tolist() + ([f"A{k}!" for k in range(15)] if bad else [])), int(not bad)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    rules = quality_rules.learned(docs, labels)
    assert rules and all(c[0] in quality_rules.FEATURES for r in rules for c in r)
    plain = {r.doc_id: r for r in quality_rules.statistics(docs).collect()}
    got = {r.doc_id: r for r in quality_rules.judge_quality(docs, rules).collect()}
    for i, t, q in rows:
        first = next((n for n, r in enumerate(rules, 1) if all(plain[i][f] >= x if op == ">=" else plain[i][f] <= x for f, op, x in r)), None)
        assert got[i].rule == first and got[i].kept == (first is None and not got[i].base_failed)
    assert np.mean([got[i].kept == bool(q) for i, _, q in rows if not got[i].base_failed]) > 0.95
