"""Each operator on edge cases, empty tables and against brute force."""

import hashlib
import math
import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import edge_rows
from pyspark.sql import functions as F

from readloom.llm import ann, components, encoding, hashing, langid, line_dedup, lm_score, minhash, mixing, packing, quotes, simhash, substring

tokenizers = pytest.importorskip("public_tokenizers")
DOCS = [(r[0], r[1]) for r in edge_rows()]
TOKENIZER = tokenizers.path("word_bpe_49k.json")


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


# Words and hashes


@pytest.mark.parametrize("step", [1, 7, 1 << 20])
def test_words_are_those_of_the_pattern(step):
    texts = [t for _, t in DOCS]
    got, hashes = [], {}
    for w in hashing.steps(pa.array(texts), step_bytes=step):
        h = hashing.word_hashes(w)
        for t in range(len(w.first) - 1):
            words = [bytes(w.data[w.starts[i] : w.ends[i]]).decode() for i in range(w.first[t], w.first[t + 1])]
            got.append(words)
            for x, y in zip(words, h[w.first[t] : w.first[t + 1]].tolist(), strict=True):
                assert hashes.setdefault(x, y) == y
    assert got == [brute.WORD.findall(t or "") for t in texts]
    assert len(set(hashes.values())) == len(hashes)


def test_windows_do_not_depend_on_place():
    h = np.arange(1, 200, dtype=np.uint64) * np.uint64(2654435761)
    for k in (5, 35):
        x = hashing.windows(np.concatenate([h[:60], h[:60]]), k)
        assert (x[: 60 - k + 1] == x[60 : 60 + 60 - k + 1]).all()


# 1


def test_lm_score(spark, edge, empty):
    targets = spark.createDataFrame([(4,), (4,), (99,)], "doc_id long")
    got = lm_score.cross_entropy_difference(edge, targets).collect()
    out = {(r.id, r.n_tokens): r for r in got}
    assert len(got) == len(DOCS)
    assert out[(0, 0)].score is None and out[(1, 0)].target_loss is None
    assert lm_score.cross_entropy_difference(empty, targets).count() == 0


# 2


def targets_by_hand(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = {}, sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        left, weight = total - sum(full.values()), sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / weight > most * sizes[s]]
        if not over:
            return full | {s: left * w[s] / weight for s in open_}
        full |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {(None if i == 5 else f"s{i}"): rng.choice([1, 10, 100, 1000]) * rng.randint(1, 9) for i in range(9)}
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = targets_by_hand(sizes)
    assert all(math.isclose(got[s], want[s], rel_tol=1e-9) for s in sizes)


def test_mix(spark, edge, empty):
    q = spark.createDataFrame([(4, 2.0), (4, 1.0), (5, -1.0), (6, None)], "doc_id long, weight double")
    a = rows_of(mixing.mix_sources(edge, quality=q), "id", "size", "source_size", "target", "taken")
    assert a == rows_of(mixing.mix_sources(edge.repartition(5), quality=q), "id", "size", "source_size", "target", "taken")
    assert sorted(r[1] for r in a) == sorted(len(brute.WORD.findall(t or "")) for _, t in DOCS)
    assert all(r[4] <= 3 * r[1] for r in a)
    assert mixing.mix_sources(empty).count() == 0


def test_mix_meets_targets(spark):
    rng = random.Random(1)
    docs = [(i, "w " * rng.randint(1, 60), f"s{min(rng.randint(0, 8), 4)}") for i in range(1500)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    out = mixing.mix_sources(df, buckets=16).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w")).collect()
    assert all(abs(r.t - r.w) <= 3 for r in out)


def test_draw_is_the_sample_by_keys(spark):
    """Keys from the rows, then epochs and prefix in plain Python: but for the closing documents the same."""
    rng = random.Random(2)
    docs = [(i, "w " * rng.choice([0, 1, 5, 40, 300]), rng.choice("aabc")) for i in range(900)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)
    q = df.selectExpr("doc_id", "case when doc_id % 3 = 0 then 2.0D else 0.5D end as weight")
    got = mixing.mix_sources(df, quality=q, buckets=8).collect()
    u = {r.doc_id: (r.h & (2**64 - 1)) >> 11 for r in df.select("doc_id", F.xxhash64(F.lit(11), "doc_id").alias("h")).collect()}
    key = lambda r: (-math.log((u[r.id] + 0.5) / 2**53) / (2.0 if r.id % 3 == 0 else 0.5), r.id)
    for s in "abc":
        own = sorted([r for r in got if r.source == s and r.size], key=key)
        target, size = own[0].target, own[0].source_size
        whole = min(3, int(target / size + 1e-9))
        left, differ = target - whole * size, 0
        for r in own:
            left -= r.size
            differ += r.taken != (whole + (whole < 3 and left >= 0)) * r.size
        assert differ <= mixing.CLOSING


def test_good_documents_are_drawn_first(spark):
    df = spark.createDataFrame([(i, "a b c", "s" if i < 2000 else "t") for i in range(2200)], "doc_id long, text string, source string")
    q = df.selectExpr("doc_id", "case when doc_id % 2 = 0 then 4.0D else 1.0D end as weight")
    # Source t stops at three times its 600 words, so s gets 4800 of its 6000.
    out = mixing.mix_sources(df, quality=q, weights=(1, 1)).filter("source = 's'")
    most = out.agg(F.max("epochs")).first()[0]
    chosen = out.filter(F.col("epochs") == most)
    if chosen.count() < out.count():
        assert chosen.filter("id % 2 = 0").count() > chosen.filter("id % 2 = 1").count()


# 3


def test_lines(edge, empty):
    got = rows_of(line_dedup.dedup_lines(edge).select("doc_id", F.col("n_lines").cast("long").alias("n"), "n_dropped", F.sha2("text", 256).alias("h")), "doc_id", "n", "n_dropped", "h")
    assert got == sorted(brute.lines(DOCS), key=str)
    assert line_dedup.dedup_lines(empty).count() == 0


# 4


def reference_ids(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    return [[*tok.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def test_encoder_equals_the_tokenizer():
    rng = random.Random(0)
    alphabet = "abAB éÉ×'<|>.,1२ٳ́  \x1f\n漢ßİΣ_-"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(1500)] + ["<|endoftext|> x<|startoftext|>", "don't I'LL 'S", "A" * 300, None, ""]
    texts += [t for _, t in DOCS]
    enc = encoding.Encoder(TOKENIZER, True)
    for _ in range(2):  # the second time from the table
        got = [np.frombuffer(x, enc.dtype).tolist() for a in enc.encode(pa.array(texts), 1) for x in a.to_pylist()]
        assert got == reference_ids(texts)
    whole = encoding.Encoder(TOKENIZER, False)
    assert [np.frombuffer(x, whole.dtype).tolist() for a in whole.encode(pa.array(texts[:50]), 1) for x in a.to_pylist()] == reference_ids(texts[:50])


@pytest.mark.parametrize("part_tokens", [500, 1 << 22])
def test_pack_round_trip(spark, edge, empty, part_tokens):
    pieces = packing.pack(edge, TOKENIZER, part_tokens=part_tokens, size=256, packet=64).collect()
    ids = {}
    for (i, t), x in zip(DOCS, reference_ids([t for _, t in DOCS]), strict=True):
        ids.setdefault((i, t), x)
    by_len = [(r.id, r.doc_tokens) for r in pieces if r.start == 0]
    assert sorted(by_len, key=str) == sorted([(i, len(ids[i, t])) for i, t in DOCS], key=str)
    known = {(i, zlib.crc32(np.array(x, "<u4").tobytes())): x for (i, _), x in ids.items()}
    assert sum(r.length for r in pieces) == sum(len(ids[i, t]) for i, t in DOCS)
    texts = {}
    for (i, _), x in ids.items():
        texts.setdefault((i, len(x)), []).append(x)
    for r in pieces:
        assert any(zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in texts[r.id, r.doc_tokens])
    seqs = {}
    for r in pieces:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at == 256 or at & (at - 1) == 0
    assert known and packing.pack(empty, TOKENIZER).count() == 0


def test_windows_hold_the_mixture():
    rng = random.Random(2)
    queues = []
    for n in (3000, 1500, 500):
        q = packing._Queue()
        left = n * 40
        while left > 0:
            k = min(left, rng.randint(50, 3000))
            q.items.append((0, 0, np.zeros(k, np.uint16), 0, k, None))
            left -= k
        queues.append(q)
    share, deficit = np.array([0.6, 0.3, 0.1]), np.zeros(3)
    owner = {id(x): s for s, q in enumerate(queues) for x in q.items}
    taken, worst, total = np.zeros(3), 0.0, 0
    for pieces in packing.deficit_round_robin(queues, share, deficit, 2048, 512, 0.1, False):
        for doc, a, b in pieces:
            taken[owner[id(doc)]] += b - a
        total += 2048
        worst = max(worst, np.abs(taken - share * total).max())
    assert total > 150_000 and worst <= 3 * 512


def test_deficits_are_carried_from_partition_to_partition(spark):
    rng = random.Random(12)
    per = [(p, s, rng.randint(1, 900)) for p in range(6) for s in ("a", "b", None) if rng.random() < 0.8]
    total = sum(t for *_, t in per)
    share = {s: sum(t for _, x, t in per if x == s) / total for s in ("a", "b", None)}
    tables = spark.createDataFrame(per, "part long, source string, t long"), spark.createDataFrame(list(share.items()), "source string, share double")
    got = {(r.part, r.source): (r.deficit, r.share) for r in packing.carried(*tables).collect()}
    assert len(got) == len(per)
    for p, s, _ in per:
        want = share[s] * sum(t for q, _, t in per if q < p) - sum(t for q, x, t in per if q < p and x == s)
        assert math.isclose(got[p, s][0], want, abs_tol=1e-6) and math.isclose(got[p, s][1], share[s])


# 5


def test_edits(edge, empty):
    got = {}
    for r in simhash.fingerprint_edits(edge).collect():
        got.setdefault(r.id, []).append(r)
    assert sum(map(len, got.values())) == len(DOCS)
    order = sorted([(i, t or "") for i, t in DOCS if i is not None], key=lambda x: -x[0])
    # Repeated and null ids have no fixed order among themselves: only unique neighbours are compared.
    for (i, t), (j, nxt) in zip(order, order[1:], strict=False):
        if len(got[i]) == 1 and len(got[j]) == 1:
            r = got[i][0]
            assert r.n_chars == len(t)
            assert r.edited_sha256 == hashlib.sha256(simhash.edit(t, nxt).encode()).hexdigest()
            assert 0 <= r.near_edited <= 1 and math.isclose(r.near_next, 1 - bin(int(r.fingerprint, 16) ^ int(got[j][0].fingerprint, 16)).count("1") / 256)
    assert got[5][0].fingerprint == got[6][0].fingerprint != got[4][0].fingerprint
    assert simhash.fingerprint_edits(empty).count() == 0


def test_single_document_follows_itself(spark):
    r = simhash.fingerprint_edits(spark.createDataFrame([(1, "ab cd")], "doc_id long, text string")).first()
    assert r.edited_sha256 == hashlib.sha256(b"ab ab").hexdigest() and r.near_next == 1.0


def test_near_fingerprints_finds_all(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(256) for _ in range(15)]
    prints = set(base)
    for b in base:
        for d in (1, 5, 12, 13, 20):
            x = b
            for k in rng.sample(range(256), d):
                x ^= 1 << k
            prints.add(x)
    df = spark.createDataFrame([(f"{x:064x}",) for x in prints] * 2, "fingerprint string")
    got = {(r.a, r.b, r.distance) for r in simhash.near_fingerprints(df, 12).collect()}
    names = sorted(f"{x:064x}" for x in prints)
    d = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
    assert got == {(a, b, d(a, b)) for i, a in enumerate(names) for b in names[i + 1 :] if d(a, b) <= 12}


# 6


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(edge, empty, percent):
    got = [r for r in rows_of(minhash.near_duplicates(edge, percent=percent), "id", "n_shingles", "component_id") if r[0] is not None]
    want = [r for r in brute.near(DOCS, percent) if r[0] is not None]
    assert got == sorted(want, key=str)
    assert minhash.near_duplicates(empty).count() == 0


def test_family_of_near_copies(spark):
    """A tree of edits: links between some members only, many components."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    family = [[word() for _ in range(90)]]
    for _ in range(220):
        x = list(rng.choice(family))
        for _ in range(rng.randint(1, 3)):
            x[rng.randrange(len(x))] = word()
        family.append(x)
    docs = [(i, " ".join(x)) for i, x in enumerate(family)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = rows_of(minhash.near_duplicates(df, percent=85, rounds=1), "id", "n_shingles", "component_id")
    assert got == sorted(brute.near(docs, 85), key=str)


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(root(a), root(b))] = min(root(a), root(b))
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.label for r in components.components(df).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}


# 7


def test_languages(spark, edge, empty):
    rng = random.Random(7)
    words = {"en": ["the", "and", "with", "from", "that"], "de": ["und", "nicht", "über", "schön", "auch"], "fr": ["être", "avec", "pour", "dans", "été"], "es": ["año", "para", "como", "más", "está"], "it": ["perché", "della", "sono", "questo", "gli"], "pt": ["não", "você", "então", "uma", "isso"]}
    docs = [(i, " ".join(rng.choice(words[x]) for _ in range(20)), x) for i, x in ((i, list(words)[i % 6]) for i in range(600))]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    out = langid.predict(df, langid.fit(df), keep=("lang",)).withColumn("h", langid.held_out("id")).collect()
    held = [r for r in out if r.h]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert {r.id for r in held} == {i for i, *_ in docs if zlib.crc32(str(i).encode()) % 5 == 0}
    m = langid.fit(edge)
    got = langid.predict(edge, m, keep=("text", "score")).collect()
    assert len(got) == len(DOCS) and all(0 <= float(r[2]) <= 1 for r in got)
    for r in got:
        assert (r.lang_pred == "und") == (r.text is None or not any(c.isalpha() for c in r.text))
    assert langid.predict(empty, langid.fit(empty)).count() == 0
    none = langid.predict(edge, langid.fit(empty)).select("lang_pred").distinct().collect()
    assert [r.lang_pred for r in none] == ["und"]


def test_codewords_are_distinct():
    for n in (1, 2, 5, 6, 40):
        c = langid.codewords(n)
        assert len({r.tobytes() for r in c}) == n


# 8


def test_neighbours_recall(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    x[100:400] = x[100]  # one vector of many rows
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [float("nan")] * 16), (5004, [1.0, None] * 8), (5005, [1.0, 2.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest_neighbours(df, lambda c: c % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(1500), d))[:10]
        rows = sorted(got[q])
        assert [r[0] for r in rows] == list(range(1, 11))
        assert [(s, v) for _, v, s in rows] == sorted((s, v) for _, v, s in rows)
        assert all(math.isclose(d[v], s, abs_tol=1e-12) for _, v, s in rows)
        hit += len({v for _, v, _ in rows} & set(want.tolist()))
        if q == 100:
            assert [v for _, v, _ in rows] == list(range(101, 111))
    assert hit / 150 >= 0.9


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r["rank"], r.vec_id, r.score) for r in ann.nearest_neighbours(df, lambda c: c == 0).orderBy("rank").collect()]
    assert got == [(1, 2, 1.0), (2, 1, math.sqrt(2))]
    assert ann.nearest_neighbours(df.limit(0), lambda c: c == 0).count() == 0
    assert ann.nearest_neighbours(df.limit(1), lambda c: c == 0).count() == 0


# 9


def test_quotes(spark):
    rows = [
        (1, 0, "u", "Hello there my friend\nHow are you doing today?"), (1, 1, "a", "> hello  there my FRIEND how are\n> you doing today?\nI am fine thanks a lot"), (1, 2, "u", "> I am fine thanks a lot\n> > Hello there my friend\nGood to hear that"),
        (1, 3, "a", ">> I am fine thanks a lot\nnone"), (1, 4, "a", "> unknown passage here ok\nx"), (1, 5, "u", None), (None, 1, "u", "> Hello there my friend"), (2, 0, "u", ""), (1, 3, "a", ">> I am fine thanks a lot\nnone"), (1, None, None, "x"),
        (1, 6, "u", "> doing\nyes"), (1, 7, "a", ">\n"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as k", "'y' as root", "'z' as conv", "'w' as position")
    out = quotes.link_quotes(df)
    got = {(r.conv_id, r.turn): (r.text, r.n_quoted, r.n_linked, r.max_level, r.reply_to, r.root, r.depth, r.position) for r in out.collect()}
    assert out.count() == len(rows)
    assert got[1, 0][4:] == (None, 0, 0, 0)
    assert got[1, 1] == ("I am fine thanks a lot", 1, 1, 1, 0, 0, 1, 1)
    assert got[1, 2] == ("Good to hear that", 2, 2, 2, 1, 0, 2, 2)
    assert got[1, 3] == ("none", 1, 1, 2, 2, 0, 3, 3)  # through the message that quoted it
    assert got[1, 4] == ("x", 1, 0, 1, None, 4, 0, 0)
    assert got[1, 5] == ("", 0, 0, 0, None, 5, 0, 0) and got[None, 1][4] is None
    assert got[1, 6][1:] == (1, 1, 1, 0, 0, 1, 4) and got[1, 7][1:5] == (0, 0, 0, None)
    threads = quotes.transcripts(out).filter("conv = 1 and root = 0").first()
    assert [m.turn for m in threads.messages] == [0, 1, 2, 3, 3, 6]
    assert quotes.link_quotes(df.limit(0)).count() == 0


def mailing_list(seed=3):
    """Conversations whose messages quote whole and partial passages, wrapped anew and nested."""
    rng = random.Random(seed)
    rows = []
    for conv in range(12):
        sent = []
        for turn in range(rng.choice([1, 8, 40, 90])):
            lines = []
            for _ in range(rng.randint(0, 3)):
                if sent and rng.random() < 0.8:
                    words = rng.choice(rng.choice(sent)).split()
                    if rng.random() < 0.5:
                        lo = rng.randrange(len(words))
                        words = words[lo : lo + rng.randint(1, 12)]
                    if rng.random() < 0.1:
                        words.append("changed")
                    mark, step = rng.choice(["> ", "> ", ">> ", "> > >"]), rng.randint(2, 9)
                    lines += [mark + " ".join(words[i : i + step]).upper() for i in range(0, len(words), step)]
                lines += rng.choice([[], [""], [">"]])
            blocks = [" ".join(rng.choice("abcdefg") * rng.randint(1, 2) for _ in range(rng.randint(1, 20))) for _ in range(rng.randint(0, 3))]
            for x in blocks:
                lines += [x, ""]
            if blocks:
                sent.append(blocks)
            rows.append((conv, turn, "u", "\n".join(lines)))
    return rows


def test_quotes_against_sql(spark):
    import duckdb
    import pandas as pd

    from readloom.llm.queries import QUOTES_SQL

    rows = mailing_list()
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"])
    con = duckdb.connect()
    con.register("conversations", conversations)
    res = con.execute(QUOTES_SQL)
    names = [x[0] for x in res.description]
    want = sorted(tuple(str(x) for x in r) for r in res.fetchall())
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = quotes.link_quotes(df).withColumn("text_sha256", F.sha2("text", 256)).select(*names).collect()
    assert sorted(tuple(str(x) for x in r) for r in got) == want
    assert sum(r.n_linked for r in got) > 100 and max(r.depth for r in got) > 5 and max(r.max_level for r in got) == 3


# 10


def test_repeats(edge, empty):
    got = rows_of(substring.remove_repeats(edge, batches=2).select("doc_id", F.col("n_words").cast("long").alias("n"), "n_removed", F.sha2("text", 256).alias("h")), "doc_id", "n", "n_removed", "h")
    assert got == sorted(brute.repeats(DOCS), key=str)
    assert substring.remove_repeats(empty).count() == 0


def test_repeats_in_many_shapes(spark):
    rng = random.Random(9)
    word = lambda: rng.choice("abcd") * rng.randint(1, 3)
    passages = [[f"p{k}w{i}" for i in range(n)] for k, n in enumerate((34, 35, 36, 50, 120))]
    docs = []
    for i in range(60):
        w = [f"d{i}x{j}" for j in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 5)
            w += p[a:] + [word() for _ in range(rng.randint(0, 3))]
        docs.append((i, " ".join(w)))
    docs += [(100, "same " * 90), (101, "ab cd " * 40), (102, docs[3][1]), (103, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = rows_of(substring.remove_repeats(df).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("h")), "doc_id", "n_words", "n_removed", "h")
    assert got == sorted(brute.repeats(docs), key=str)


def test_index_over_batches(spark, tmp_path):
    passage = lambda x, n=40: " ".join(f"{x}{i}" for i in range(n))
    batches = [
        [(1, passage("w") + " a b"), (2, "c d e"), (20, passage("u", 80))],
        [(3, "x " + passage("w")), (4, passage("v", 60))],
        [(5, passage("y")), (1, "other text of one id " + passage("v", 60)), (6, passage("u", 50) + " z")],
        [(7, passage("w")), (8, passage("y") + " tail"), (9, "b " + passage("y")), (9, "b " + passage("y")), (None, passage("v", 36)), (10, "q " + passage("u", 80)[12:])],
    ]
    index = substring.FingerprintIndex(spark, f"file://{tmp_path}/index", buckets=3)
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    seen, gone = [], {}
    for i, rows in enumerate(batches):
        old = df(seen) if seen else None
        if i == 2:  # added twice under one number: counted once
            index.add(df(rows), history=old, batch=2)
        for r in index.add(df(rows), history=old, batch=i).collect():
            gone.setdefault((r.id, r.k), set()).update(r["at"] + o + j for o in range(62) if r["mask"] >> o & 1 for j in range(35))
        if i:
            assert all(p.count("Exchange") == 0 and "SortMergeJoin" in p for p in map(executed, index.plans))
        seen += rows
        if i == 1:
            index.compact()
            assert "Exchange" not in index.plans[0] and "SelectedBucketsCount" in index.plans[0]  # merged where the rows are
            assert len(index.runs()) == 1
    with pytest.raises(ValueError):
        index.add(df(batches[0]), history=df(seen), batch=0)
    with pytest.raises(ValueError):
        index.add(df(batches[0]))
    key = {(r.doc_id, r.text): r.k for r in df(seen).select("doc_id", "text", substring.text_key(F.col("text")).alias("k")).collect()}
    got = sorted(((i, len(t.split()), len(gone.get((i, key[i, t]), ()))) for i, t in seen), key=str)
    assert got == sorted([x[:3] for x in brute.repeats(seen)], key=str)
    assert len(index.runs()) == 3


def executed(plan):
    return plan[plan.index("== Physical Plan ==") :]


def test_index_survives_an_interrupted_writer(spark, tmp_path):
    import os
    import shutil

    df = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")
    text = " ".join(f"w{i}" for i in range(60))
    index = substring.FingerprintIndex(spark, f"file://{tmp_path}/index", buckets=2)
    index.add(df((1, text)))
    index.add(df((2, "x y")), history=df((1, text)))
    one = [r.path[5:] for r in index.runs()]
    shutil.copytree(one[0], f"{tmp_path}/kept")
    index.compact()
    shutil.copytree(f"{tmp_path}/kept", one[0])  # a compaction that died before it dropped its input
    half = f"{tmp_path}/index/run-000002-000002-of-2"  # a run that was never finished
    os.makedirs(half)
    assert [(r.low, r.high) for r in index.runs()] == [(0, 1)]
    marks = index.add(df((3, text)), history=df((1, text), (2, "x y"))).collect()
    assert {r.id for r in marks} == {1, 3}
    assert [(r.low, r.high) for r in index.runs()] == [(0, 1), (2, 2)]
