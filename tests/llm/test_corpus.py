"""The corpus operators against brute force, round trips, planted cases and odd inputs."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from heddle.llm import chat, common, components, exact_dedup, langid, mixing, packing, quality_model, quality_rules, secrets, simhash, substring

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(rng, n, vocabulary=400):
    return " ".join(f"{'bcdfg'[k % 5]}{'aeiou'[k // 5 % 5]}{'lmnrst'[k % 6]}{k}" for k in (rng.randrange(vocabulary) for _ in range(n)))


def odd_texts():
    return [None, "", "  \n\t ", "word", "é ñ 日本 \U0001f600", "x" * 20_000, "a b " * 3000, "word", "w o\trd", "\x00\x0b q"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [words(rng, rng.randrange(5, 120)) for _ in range(40)]
    texts = odd_texts() + base + base[:10] + [b + " " for b in base[5:9]] + [b.replace(" ", "\n", 3) for b in base[:4]]
    out = [(i, t, ("en", "fr")[i % 2], None if i % 11 == 0 else f"s{i % 4}", None, 1.0, False) for i, t in enumerate(texts)]
    out += [out[20], out[20], (None, "no id", None, "s1", 1, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# Exact de-duplication


def squeezed(t):
    return re.sub(r"[\x20\x09-\x0D]+", "", t or "")


@pytest.mark.parametrize("bits,capacity", [(64, 4096), (64, 2), (3, 4), (1, 1)])
def test_exact_groups(docs, rows, bits, capacity):
    got = exact_dedup.exact_groups(docs, key_bits=bits, capacity=capacity).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[squeezed(r[1])].append(r)
    want = Counter()
    for bare, members in groups.items():
        best = min(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        for r in members:
            want[(r[0], best[0], len(members), hashlib.sha256(bare.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_drop_exact_copies(docs, rows, empty):
    got = exact_dedup.drop_exact_copies(docs).collect()
    assert len(got) == len({squeezed(r[1]) for r in rows}) == len({squeezed(r.text) for r in got})
    assert got[0].asDict().keys() == dict.fromkeys(docs.columns).keys()
    assert exact_dedup.drop_exact_copies(empty).count() == exact_dedup.exact_groups(empty).count() == 0


@pytest.mark.parametrize("n,capacity", [(500, 20), (0, 4), (3000, 1)])
def test_directory_splits_until_buckets_fit(spark, n, capacity):
    keys = spark.range(n).select(F.xxhash64("id").alias("key"))
    d, depth = exact_dedup.directory(keys, capacity=capacity)
    full = keys.join(d, exact_dedup.slot(F.col("key"), depth) == F.col("slot"))
    assert full.count() == n
    assert all(r["count"] <= capacity for r in full.groupBy("bucket").count().collect())


def test_directory_has_no_depth_limit(spark):
    keys = spark.range(64).select((F.lit(0x5555555555550000) + F.col("id")).alias("key"))
    d, depth = exact_dedup.directory(keys, capacity=16)
    assert depth == 60 and keys.join(d, exact_dedup.slot(F.col("key"), depth) == F.col("slot")).count() == 64


def test_index_carries_the_result(docs, monkeypatch):
    """Rows reach their group through the directory only."""
    whole = exact_dedup.directory
    monkeypatch.setattr(exact_dedup, "directory", lambda *a: (whole(*a)[0].where("false"), whole(*a)[1]))
    assert exact_dedup.exact_groups(docs).count() == 0


def test_suspects_are_never_missed(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("key"))
    some = common.Sieve(keys.limit(700))
    maybe, not_ = some.split(keys)
    assert maybe.count() + not_.count() == 5000 and not_.join(keys.limit(700), "key").count() == 0 and not_.count() > 3500


def test_hot_keys_are_joined_whole(spark):
    rows = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 700).alias("k"))
    side = rows.groupBy("k").agg(F.count("*").alias("n"))
    got = common.joined(rows, side, ["k"], "n")
    assert sorted(map(tuple, got.select("id", "k", "n").collect())) == sorted(map(tuple, rows.join(side, "k").select("id", "k", "n").collect()))


CLASHES = ["pass", "words", "__row", "__fp", "__id", "__lang", "__sha", "size", "whole", "key", "sha", "row", "fp", "best", "kept", "lang_pred", "picks", "bucket", "b_at", "bits", "dotted.name"]


@pytest.mark.parametrize("stage", [exact_dedup.drop_exact_copies, simhash.drop_near_copies, mixing.mixed_documents, langid.keep_identified])
def test_stages_keep_foreign_columns(spark, rows, stage):
    """Extra columns keep their values, whatever they are called; packing has columns of its own."""
    some = [r[:5] for r in rows if r[0] is not None]
    some = list({r[0]: r for r in some}.values())
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` long" for c in CLASHES)
    df = spark.createDataFrame([(*r, *[1000 * r[0] + k for k in range(len(CLASHES))]) for r in some], schema)
    out = stage(df)
    assert out.columns == df.columns
    got = out.collect()
    assert got and all(tuple(r)[5:] == tuple(1000 * max(r[0], -1 - r[0]) + k for k in range(len(CLASHES))) for r in got)


# Mixing


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if w[s] * level > 2 * sizes[s]}
        if not full:
            return out | {s: w[s] * level for s in free}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= full
    return out


def test_mix(docs, rows, empty):
    got = mixing.mix(docs, block=4).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    targets = brute_targets(sizes)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len(WORD.findall(r[1] or ""))) for r in rows)
    taken = Counter()
    source = {r[0]: r[3] for r in rows}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(targets[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 12
    again = mixing.mix(docs.repartition(7), block=4).collect()
    assert Counter((r.doc_id, r.taken) for r in again) == Counter((r.doc_id, r.taken) for r in got)
    assert mixing.mix(empty).count() == mixing.mixed_documents(empty).count() == 0


def test_seats_are_those_of_the_highest_quotients(spark):
    rng = random.Random(5)
    for n, seats in ((1, 7), (6, 50), (20, 13), (9, 1000)):
        t = [round(rng.expovariate(0.01), 3) for _ in range(n)]
        df = spark.createDataFrame([(f"p{i:02}", x, 10**6, seats) for i, x in enumerate(t)], "p string, target double, cap long, seats long")
        got = {r.p: r.quota for r in mixing._seats(df, [], "p").collect()}
        want = Counter()
        for _ in range(seats):
            best = max(range(n), key=lambda i: (t[i] / (2 * want[i] + 1), -i))
            want[best] += 1
        assert got == {f"p{i:02}": want[i] for i in range(n)}


def test_mixed_documents_follow_the_picks(docs):
    taken = {(r.doc_id, r.size): r.taken for r in mixing.mix(docs).where("doc_id is not null").dropDuplicates(["doc_id"]).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    sums = Counter()
    for r in out.where("doc_id is not null").collect():
        sums[max(r.doc_id, -1 - r.doc_id)] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    single = {i: t for (i, _), t in taken.items() if i != 20 and t}
    assert {i: sums[i] for i in single} == single


def test_few_documents_are_cut(spark):
    rng = random.Random(12)
    rows = [(i, words(rng, rng.randrange(20, 400)), ("a", "b", "c")[min(2, i % 5)]) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = [(r.doc_id, r.text) for r in mixing.mixed_documents(df).collect()]
    assert len({i for i, _ in out}) == len(out)
    size = sum(len(t.split()) for _, t, _ in rows)
    cut = [i for i, t in out if t != rows[max(i, -1 - i)][1]]
    assert 0 < len(cut) <= 2 * 3 * (size / (mixing.BLOCK * mixing.RUN) + 3)
    assert all(t in " ".join(rows[max(i, -1 - i)][1].split()) or i in cut for i, t in out)


# Packing


def plain_best_fit(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, room in enumerate(bins) if room >= s]
        if fits:
            i = min(fits, key=lambda i: bins[i])
            bins[i] -= s
        else:
            bins.append(capacity - s)
    return sorted(bins)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(60):
        cap = rng.choice((7, 16, 50))
        sizes = [rng.randrange(1, cap + 1) for _ in range(rng.randrange(1, 120))]
        moves, used = packing.plan(Counter(sizes), cap)
        assert used == len(plain_best_fit(sizes, cap))
        room = [cap] * used
        starts = defaultdict(list)
        for size, rank, first, per, offset in moves:
            starts[size].append((rank, first, per, offset))
        for size, n in sorted(Counter(sizes).items(), reverse=True):
            for k in range(n):
                rank, first, per, offset = [m for m in sorted(starts[size]) if m[0] <= k][-1]
                b = first + (k - rank) // per
                assert cap - room[b] == offset + (k - rank) % per * size
                room[b] -= size
        assert sorted(room) == plain_best_fit(sizes, cap)


def test_pack_round_trip(docs, rows, empty):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    got = packing.pack(docs, path, capacity=256).collect()
    plain = Tokenizer.from_file(path)
    want = Counter()
    for r in rows:
        ids = plain.encode(r[1] or "", add_special_tokens=False).ids + [1]
        for k in range(-(-len(ids) // 256)):
            part = ids[k * 256 : (k + 1) * 256]
            want[(r[0], k, k * 256, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    per = defaultdict(list)
    for r in got:
        per[r.sequence_id].append((r.offset, r.length))
    for places in per.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(empty, path).count() == 0


# SimHash


def plain_fingerprint(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(values, linked):
    roots = list(range(len(values)))

    def find(i):
        while roots[i] != i:
            i = roots[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                a, b = find(i), find(j)
                roots[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_near_groups(docs, rows, empty):
    got = simhash.near_groups(docs).collect()
    fps = [plain_fingerprint(r[1]) for r in rows]
    comp = plain_components(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    first = defaultdict(list)
    for c, r in zip(comp, rows):
        if r[0] is not None:
            first[c].append(r[0])
    want = Counter((r[0], f"{f:016x}", min(first[c]) if first[c] else None) for r, f, c in zip(rows, fps, comp))
    assert Counter(tuple(r) for r in got) == want
    assert simhash.near_groups(empty).count() == simhash.drop_near_copies(empty).count() == 0
    assert simhash.drop_near_copies(docs).count() == len(set(comp))


@pytest.mark.parametrize("chunk", [4096, 3])
def test_links_lose_no_component(spark, chunk):
    rng = random.Random(9)
    values = set()
    for _ in range(25):
        v = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            values.add(v)
            for _ in range(rng.randrange(1, 7)):
                v ^= 1 << rng.randrange(64)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), chunk).collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 4 for a, b in links)
    at = {v: i for i, v in enumerate(signed)}
    pairs = {(at[a], at[b]) for a, b in links} | {(at[b], at[a]) for a, b in links}
    order = list(range(len(values)))
    assert plain_components(order, lambda i, j: (i, j) in pairs) == plain_components(order, lambda i, j: (values[i] ^ values[j]).bit_count() <= 4)


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(100, k) for k in range(101, 130)] + [(rng.randrange(200, 240), rng.randrange(200, 240)) for _ in range(25)] + [(5, 5), (None, 1)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    nodes = sorted({x for p in real for x in p})
    comp = plain_components(nodes, lambda x, y: (x, y) in real or (y, x) in real)
    assert got == {n: nodes[c] for n, c in zip(nodes, comp)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# Substring de-duplication


def test_repeats(spark, empty):
    rng = random.Random(8)
    passages = [words(rng, n, 5000) for n in (51, 60, 90, 120)]
    rows, planted = [], defaultdict(set)
    for i in range(120):
        parts = [words(rng, rng.randrange(30, 90), 5000)]
        if i % 4 == 0:
            k = i // 4 % 4
            parts += [passages[k], words(rng, 20, 5000)]
            planted[k].add(i)
        rows.append((i, " ".join(parts)))
    near = passages[3].split()
    near[60] = "changed"
    rows += [(200, " ".join(near)), (201, None), (202, ""), (203, "x y z"), (204, "loop " * 500), (None, passages[0])]
    df = spark.createDataFrame([(*r, "extra", 0) for r in rows], "doc_id long, text string, cluster_id string, at int")
    got = substring.repeats(df).collect()
    found = {r.doc_id for r in got}
    assert found == set().union(*planted.values()) | {200}
    text = {i: (t or "").split() for i, t in rows}
    for r in got:
        assert r.end - r.start >= substring.LEAST and r.end <= len(text[r.doc_id])
        assert r.kept == (r.first_doc_id == r.doc_id)
    for members in planted.values():
        assert {r.first_doc_id for r in got if r.doc_id in members} == {min(members)}
    small = substring.repeats(df, chunk=2).collect()
    assert sorted(tuple(r) for r in small) == sorted(tuple(r) for r in got)
    assert substring.repeats(empty).count() == 0


def test_similar_paragraphs_join(spark):
    rng = random.Random(6)
    shared = words(rng, 70, 9000).split()
    ends = shared[:]
    ends[-1] = "other"
    df = spark.createDataFrame([(1, " ".join(shared)), (2, " ".join(ends)), (3, words(rng, 80, 9000))], "doc_id long, text string")
    assert {r.doc_id for r in substring.repeats(df).collect()} == {1, 2}


def plain_bands(tokens, n_bands, rows):
    """The set of (band key, first shingle) over all paragraphs, one paragraph at a time."""
    hashes = np.array([xxhash.xxh64_intdigest(w.lower().encode()) for w in tokens], np.uint64)
    shingles = [int(substring.shingles_of(hashes[i : i + substring.SHINGLE])[0]) for i in range(len(tokens) - substring.SHINGLE + 1)]
    out = set()
    for i in range(len(tokens) - substring.PARAGRAPH + 1):
        part = np.array(shingles[i : i + substring.SHINGLES], np.uint64)
        for band in range(n_bands):
            key, first = np.array([band], np.uint64), None
            for row in range(rows):
                k = band * rows + row
                order = substring._mix(part ^ (substring._ODD[[k % 8]] * np.uint64(2 * k + 1)))
                first = int(part[order.argmin()]) if row == 0 else first
                key = substring._mix(key * substring._ODD[6] + order.min())
            out.add((int(key[0]), first))
    return out


@pytest.mark.parametrize("n_bands,rows", [(1, 2), (3, 2), (2, 1)])
def test_bands_are_the_minhashes_of_all_paragraphs(n_bands, rows):
    rng, table = random.Random(n_bands), substring._Words()
    for n in (23, 24, 25, 60, 300):
        tokens = words(rng, n, 5000).split()
        found = substring.bands_of(" ".join(tokens).encode(), table, n_bands, rows)
        if n < substring.PARAGRAPH:
            assert found is None
            continue
        at, key, _ = found
        hashes = np.array([xxhash.xxh64_intdigest(w.encode()) for w in tokens], np.uint64)
        shingles = substring.shingles_of(hashes)
        assert set(zip(key.tolist(), shingles[at].tolist())) == plain_bands(tokens, n_bands, rows)


def test_bands_are_tuned():
    assert substring.BANDS == 1 and substring.bands(50, paragraph=40) > 1
    assert substring.bands(50, paragraph=60 - 10, rows=4) > substring.bands(50, paragraph=50, rows=2)


def test_every_passage_of_fifty_words_has_a_common_band():
    rng = random.Random(1)
    table = substring._Words()
    for _ in range(200):
        passage = words(rng, 50, 300)
        keys = []
        for _ in range(2):
            text = f"{words(rng, rng.randrange(60), 300)} {passage} {words(rng, rng.randrange(60), 300)}".encode()
            keys.append(set(substring.bands_of(text, table)[1].tolist()))
        assert keys[0] & keys[1]


def test_repeated_ids_and_long_texts(spark):
    rng = random.Random(31)
    passage, other = words(rng, 90, 60_000), words(rng, 90, 60_000)
    long = f"{words(rng, 30_000, 60_000)} {passage} {words(rng, 30_000, 60_000)}"
    rows = [(1, passage), (1, other), (1, other), (2, other), (2, other), (3, long), (None, passage), (None, other)]
    got = substring.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.end - r.start, r.first_doc_id, r.kept) for r in got) == [(1, 90, 1, True), (1, 90, 1, True), (2, 90, 1, False), (3, 90, 1, False)]
    assert len({r.cluster_id for r in got}) == 2
    alike = substring.repeats(spark.createDataFrame([(5, passage)] * 3, "doc_id long, text string"))
    assert alike.count() == 0  # one document


def test_repeats_against_brute_force(spark):
    """Exact repeats: every word inside a run of PARAGRAPH words that another document has, and no word outside such a run of LEAST."""
    rng = random.Random(41)
    passages = [words(rng, rng.randrange(10, 80), 60_000).split() for _ in range(12)]
    texts = []
    for _ in range(60):
        t = []
        for _ in range(rng.randrange(1, 5)):
            t += words(rng, rng.randrange(30), 60_000).split() + rng.choice(passages)
        texts.append(t)
    got = substring.repeats(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    covered = defaultdict(set)
    for r in got:
        covered[r.doc_id] |= set(range(r.start, r.end))

    def shared(n):
        where = defaultdict(set)
        for i, t in enumerate(texts):
            for k in range(len(t) - n + 1):
                where[tuple(t[k : k + n])].add(i)
        return {i: {k + j for k in range(len(t) - n + 1) if len(where[tuple(t[k : k + n])]) > 1 for j in range(n)} for i, t in enumerate(texts)}

    surely = shared(substring.PARAGRAPH)
    missing = sum(len(surely[i] - covered[i]) for i in surely)
    assert missing <= 0.02 * sum(map(len, surely.values()))
    five = shared(substring.SHINGLE)
    assert sum(len(covered[i] - five[i]) for i in covered) <= 0.02 * sum(map(len, covered.values()))


def edited(rng, passage, n):
    """``passage`` with ``n`` words changed, added or dropped, evenly spread; and the Jaccard similarity of the shingles."""
    out = list(passage)
    for k in range(n, 0, -1):
        at, how = len(passage) * k // (n + 1), rng.randrange(3)
        out[at : at + (how < 2)] = [f"edit{rng.randrange(10**9)}"] * (how > 0)
    a, b = ({tuple(x[i : i + substring.SHINGLE]) for i in range(len(x) - substring.SHINGLE + 1)} for x in (passage, out))
    return out, len(a & b) / len(a | b)


def test_near_copies_of_passages_are_found(spark):
    rng = random.Random(21)
    rows, spans = [], {}
    for n in (50, 60, 90, 120, 200, 400):
        done = 0
        while done < 12:
            passage = words(rng, n, 60_000).split()
            other, similarity = edited(rng, passage, rng.randrange(1, 1 + n // 47))
            if similarity < substring.SIMILARITY or len(other) < 50:
                continue
            done += 1
            for version in (passage, other):
                before = words(rng, rng.randrange(1, 150), 60_000).split()
                spans[len(rows)] = (n, len(before), len(before) + len(version))
                rows.append((len(rows), " ".join([*before, *version, *words(rng, 150, 60_000).split()])))
    got = substring.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    whole = {r.doc_id for r in got if (r.start, r.end) == spans[r.doc_id][1:]}
    assert whole == set(spans)
    assert all(r.kept == (r.doc_id % 2 == 0) and r.first_doc_id == r.doc_id // 2 * 2 for r in got)


def test_one_copy_of_adjacent_passages_stays(spark):
    rng = random.Random(22)
    passages = [words(rng, rng.randrange(50, 70), 60_000).split() for _ in range(6)]
    rows, places = [], {}
    # The first three are A, A next to B, and B; in the others any passages stand side by side or 31 words apart.
    for i, ks in enumerate([[0], [0, 1], [1]] + [[rng.randrange(6) for _ in range(rng.randrange(1, 5))] for _ in range(40)]):
        text = words(rng, 40, 60_000).split()
        for k in dict.fromkeys(ks):
            places[i, k] = len(text), len(text) + len(passages[k])
            text += [*passages[k], *words(rng, rng.choice([0, 31]), 60_000).split()]
        rows.append((i, " ".join(text)))
    got = substring.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    gone = defaultdict(set)
    for r in got:
        if not r.kept:
            gone[r.doc_id] |= set(range(r.start, r.end))
    first = {}
    for i, k in places:
        first[k] = min(i, first.get(k, i))
    for (i, k), (start, end) in places.items():
        assert len(gone[i] & set(range(start, end))) == (0 if i == first[k] else end - start), (i, k)
    assert sum(map(len, gone.values())) == sum(end - start for (i, k), (start, end) in places.items() if i != first[k])


def test_repeated_passages_are_covered_whole(spark):
    rng = random.Random(23)
    rows, spans = [], {}
    for n in [24, 51, 60, 90, 120] * 8:
        passage = words(rng, n, 60_000)
        for _ in range(2):
            before = rng.randrange(60)
            spans[len(rows)] = before, before + n
            rows.append((len(rows), f"{words(rng, before, 60_000)} {passage} {words(rng, rng.randrange(60), 60_000)}"))
    got = substring.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.start, r.end) for r in got) == sorted((i, *s) for i, s in spans.items())


# Quality rules


def plain_counts(text):
    t = text or ""
    w = WORD.findall(t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_cascade(spark, docs, rows, empty):
    texts = [r[1] for r in rows] + ["# a | b\n# a | b\n\n# a | b c d e a | b c", "one two three " * 30, "YES! " * 60, " ".join(f"w{i}" for i in range(60))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in quality_rules.judge(df).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], plain_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)
    assert quality_rules.judge(empty).count() == 0
    counted = quality_rules.with_text_counts(df.select("doc_id", "text"))
    tests = quality_rules.rules()
    some = [counted.select("doc_id", quality_rules.cascade(tests, o).isNull().alias("k")).orderBy("doc_id").collect() for o in (list(tests), list(tests)[::-1])]
    assert some[0] == some[1]


def test_cascade_order_is_that_of_counted_work(spark, docs):
    rows = docs.select("doc_id", "text")
    tests = quality_rules.rules()
    first = quality_rules.ordered(rows, tests)
    assert first == quality_rules.ordered(rows.repartition(5), tests)
    assert [x[2] / max(1, x[1]) for x in first] == sorted((x[2] / max(1, x[1]) for x in first), reverse=True)
    size = np.mean([len(r.text or "") for r in rows.collect()])
    assert {n: round(w, 6) for n, w, _ in first} == {n: round(1 + r.scans * size, 6) for n, r in tests.items()}
    told = lambda d: sorted((r.doc_id is None, r.doc_id or 0, r.failed_rule or "") for r in quality_rules.judge(d).collect())
    assert told(docs) == told(docs.repartition(7))


# Secrets


def test_markov_models_on_strings_they_did_not_learn_from(spark):
    """Recall on fresh random strings, false alarms on ordinary ones: words of documents that were held apart and names that people give."""
    rng = random.Random(77)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text") if Path("/root/testdata/sf0.01").exists() else None
    if docs is None:
        pytest.skip("no test data here")
    table = secrets.train(secrets.labelled_samples(spark, docs.where("doc_id % 2 = 0")))
    b64, upper, hexa = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEF"
    secret = ["".join(rng.choice(a) for _ in range(rng.randrange(20, 44))) for a in (b64, upper, hexa) for _ in range(300)]
    apart = [w for r in docs.where("doc_id % 2 = 1").collect() for w in re.findall(r"[A-Za-z]{3,12}", r.text or "") if w.islower() or w.istitle() or w.isupper()]
    rng.shuffle(apart)
    ordinary = ["_".join(apart[i : i + 3]).lower() for i in range(0, 900, 3)] + ["".join(w.capitalize() for w in apart[i : i + 3]) for i in range(900, 1800, 3)] + ["/".join(apart[i : i + 4]) for i in range(1800, 3000, 4)]
    ordinary = [w for w in ordinary if len(w) >= secrets.LEAST] + ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "qwertyuiopasdfgh", "01234567890123456789", "AbstractSingletonProxyFactoryBean", "2024-01-31T00-00-00"]
    df = spark.createDataFrame(list(enumerate(secret + ordinary)), "doc_id long, text string")
    hit = {r.doc_id for r in secrets.report(df, table).collect() if "random" in r.spans}
    found, alarms = sum(i < len(secret) for i in hit) / len(secret), sum(i >= len(secret) for i in hit) / len(ordinary)
    print("recall", found, "false alarms", alarms, [ordinary[i - len(secret)] for i in sorted(hit) if i >= len(secret)][:10])
    assert found >= 0.95 and alarms <= 0.03


def test_secret_spans(spark, empty):
    b64 = "wJalrXUtnFEMIK7MDENGbPxRfiCYzEXAMPLEKEY9qT"
    texts = odd_texts() + [
        'Token = "abcdef" passſword: nothing', "APIKEY:short api_key = 'longer-value' PASSWD=x secret=\"a.b/c+d=\"", "é AKIA" + "A1" * 8 + " AKIAshort AKIA" + "Z" * 15,
        "0" * 23 + " " + "af09" * 6 + "g" + "12ab" * 7, f"see {b64} and an_ordinary_identifier_name here", "token=" + "a1b2c3d4" * 5,
    ]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, base int")
    got = {r.doc_id: r for r in secrets.report(df).collect()}
    key = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token"))
    kinds = {
        "assign": (re.compile(rf"""({key}|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
        "access": (re.compile("AKIA[A-Z0-9]+"), 0, 20),
        "hex": (re.compile("[0-9a-f]+"), 0, 24),
    }
    for i, t in enumerate(texts):
        base = sorted((m.start(), k, m.end(), name) for k, (name, (p, part, least)) in enumerate(kinds.items()) for m in p.finditer(t or "") if len(m[part]) >= least)
        told = [f"{name}:{s}:{e}" for s, _, e, name in base]
        assert got[i].base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert [x for x in got[i].spans.split(",") if x and not x.startswith("random")] == told
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(b[3] == k for b in base) for k in kinds)
    assert got[len(texts) - 2].spans == f"random:4:{4 + len(b64)}"
    assert "random" not in "".join(got[i].spans for i in range(len(odd_texts())))
    assert secrets.report(empty).count() == 0


# Language identification

EN = "the cat and the dog are in the house with all of their friends that they have known for many years".split()
DE = "der hund und die katze sind in dem haus mit allen ihren freunden die sie seit vielen jahren kennen".split()
RU = "кошка и собака живут в доме вместе со всеми своими друзьями которых они знают уже много лет".split()


def test_numerals_end_words(spark):
    zh, en = "今年五月我们去了北京看朋友", "the ship will leave in may and come back"
    model = langid.train(spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([(zh, "zh"), (en, "en")] * 5)], "doc_id long, text string, lang string"))
    texts = ["二〇二四年五月", "①我们去了北京", "ship²", "½back", "²½①〇", "10 20"]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert [got[i].lang_pred for i in range(6)] == ["zh", "zh", "en", "en", "und", "und"]
    assert all(got[i].score > 0 for i in range(4)) and got[4].score == got[5].score == 0


def test_language(spark, empty):
    rng = random.Random(7)
    some = lambda v, n: " ".join(rng.choice(v) for _ in range(n))
    train = [(i, some(v, 40), lang, 1) for i, (v, lang) in enumerate([(EN, "en"), (DE, "de"), (RU, "ru")] * 20)] + [(999, None, "en", 1), (998, "x", None, 1)]
    model = langid.train(spark.createDataFrame(train, "doc_id long, text string, lang string, score int"))
    assert model.langs == ["de", "en", "ru"]
    mixed = f"{some(EN, 30)} {some(DE, 30)}"
    texts = [some(EN, 20), some(DE, 20), some(RU, 3), mixed, None, "", "123 ++ ²", "the " * 5000, "日本"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, score int")
    got = {r.doc_id: r for r in langid.identify(df, model, spans=True).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2)] == ["en", "de", "ru"] and got[7].lang_pred == "en"
    assert [got[i].lang_pred for i in (4, 5, 6)] == ["und"] * 3 and got[8].lang_pred in model.langs
    assert [s.lang for s in got[3].spans] == ["en", "de"] and got[3].n_spans == 2
    assert abs(got[3].spans[0].end - len(mixed.split(" " + DE[0])[0])) < 200 and got[3].spans[1].end == len(mixed)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(empty, model).count() == langid.keep_identified(empty).count() == 0
    nothing = langid.train(empty)
    assert {r.lang_pred for r in langid.identify(df, nothing).collect()} == {"und"}


def test_words_are_runs_of_letters():
    odd = "".join(c for c in map(chr, range(0x11_0000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
    rng = random.Random(2)
    for _ in range(2000):
        text = "".join(rng.choice(["a", "ß", "日", "я", "1", "_", " ", "-", "²", "〇", rng.choice(odd)]) for _ in range(rng.randrange(12)))
        want = [m for m in "".join(c if c.isalpha() else " " for c in text).split()]
        assert langid.words_of(text) == want == [text[i:j] for i, j in langid.word_spans(text)]


def test_scripts_narrow_and_scores_are_means(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([(" ".join(EN), "en"), (" ".join(DE), "de"), (" ".join(RU), "ru")] * 3)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = model.words(["hund", "кошка", "the"])
    assert got[0, 2] == got[2, 2] == langid.OUTSIDE and got[1].tolist() == [langid.OUTSIDE, langid.OUTSIDE, 0]
    for row, word in ((got[0], "hund"), (got[2], "the")):
        framed, cells = f"^{word}$", []
        for n in langid.ORDERS:
            for i in range(len(framed) - n + 1):
                h = sum(ord(c) * int(langid._MIX[k]) for k, c in enumerate(framed[i : i + n])) % (1 << 64)
                h = (h ^ (h >> 31)) * int(langid._MIX[1]) % (1 << 64)
                cells.append((h >> 40) % langid.CELLS)
        assert row[:2] == pytest.approx(langid.WORD_WEIGHT * model.table[cells].mean(axis=0)[:2], rel=1e-4)


def test_rare_languages_are_learned(spark):
    rows = [(i, "the cat sat on the mat", "en") for i in range(3000)] + [(9000, "der hund liegt im haus", "de")]
    df = spark.createDataFrame([*rows, (None, "the end", "en"), rows[0]], "doc_id long, text string, lang string")
    model = langid.train(df, sample_rows=50)
    assert model.langs == ["de", "en"]
    got = langid.identify(spark.createDataFrame([(1, "der hund"), (1, "der hund"), (2, "the cat")], "doc_id long, text string"), model).collect()
    assert [r.lang_pred for r in got] == ["de", "de", "en"]


@pytest.mark.parametrize(("n_langs", "n_texts", "n_words", "most_mb"), [(4, 800, 1500, 40), (64, 2000, 60, 110)])
def test_labelling_takes_a_batch_in_parts(spark, monkeypatch, n_langs, n_texts, n_words, most_mb):
    rng = np.random.default_rng(6)
    langs = [f"{k:02}" for k in range(n_langs)]
    model = langid.Model(langs, rng.normal(size=(langid.CELLS, n_langs)).astype(np.float32), {s: np.arange(n_langs) for s in langid.SCRIPTS})
    words = np.array(["".join(w) for w in rng.choice(list("abcdefghijklmnop"), (100_000, 8))])
    texts = [None, "", "12", *(" ".join(words[rng.integers(0, len(words), n_words)]) for _ in range(n_texts))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    df = spark.createDataFrame([], "doc_id long, text string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: f)
    label = langid.identify(df, model)
    tracemalloc.start()
    told = [b.drop_columns(["text"]) if "text" in b.schema.names else b for b in label(iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    got = [r for b in told for r in b.to_pylist()]
    assert [r["doc_id"] for r in got] == list(range(len(texts)))
    assert [(r["lang_pred"], r["score"], r["n_spans"]) for r in got[:3]] == [("und", 0, 0)] * 3
    for i in (3, len(texts) // 2, len(texts) - 1):
        assert got[i : i + 1] == [r for b in label(iter([batch.slice(i, 1)])) for r in b.to_pylist()]
    assert peak < most_mb


def test_counts_in_parts_add_up(monkeypatch):
    batch = pa.RecordBatch.from_arrays([pa.array(["de", "en"] * 300), pa.array([f"{chr(97 + i % 26) * 3} γ{chr(97 + i % 7)} the" for i in range(600)])], names=["lang", "text"])

    def counted():
        total = Counter()
        found = [b.to_pylist() for b in langid._count(iter([batch]))]
        for r in (r for b in found for r in b):
            total[r["lang"], r["cell"]] += r["n"]
        return len(found), total

    whole = counted()
    monkeypatch.setattr(langid, "COUNTED", 5)
    parts = counted()
    assert parts[0] > whole[0] and parts[1] == whole[1]


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    model = langid.Model(["a", "b", "c"], np.zeros((langid.CELLS, 3), np.float32), {s: np.arange(3) for s in langid.SCRIPTS})
    labeller = langid.Labeller(model)
    labeller.scores = rng.normal(0, 4, (30, 3)).astype(np.float32)
    docs = [rng.integers(0, 30, n).astype(np.int32) for n in (1, 7, 0, 6, 5)]
    value = lambda ids, path: sum(labeller.scores[i, k] for i, k in zip(ids, path)) - langid.SWITCH * sum(a != b for a, b in zip(path, path[1:]))
    import itertools

    for ids, path in zip(docs, labeller.paths(docs)):
        best = max(value(ids, p) for p in itertools.product(range(3), repeat=len(ids)))
        assert value(ids, path.tolist()) == pytest.approx(best, abs=1e-3)


# Quality classifier


def test_quality_classifier(spark, empty):
    rng = random.Random(11)
    good = lambda: ". ".join(words(rng, rng.randrange(5, 15)).capitalize() for _ in range(rng.randrange(3, 20)))
    bad = lambda: " ".join(w + "$$$" for w in words(rng, 60).split())
    rows = [(i, good() if i % 3 else bad(), int(i % 3 > 0)) for i in range(240)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, "x" * 50_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5000, 1), (3, None)], "doc_id long, label int")
    got = {r.doc_id: r for r in quality_model.classify(docs, labels, F.col("doc_id") % 2 == 0).collect()}
    assert len(got) == 243 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert sum(got[i].predicted == y for i, _, y in rows if i % 2) >= 117
    none = quality_model.classify(docs, labels.where("false"), F.lit(True)).collect()
    assert {round(r.score, 6) for r in none} == {0.5}
    assert quality_model.classify(empty, labels, F.lit(True)).count() == 0


def test_discriminant_is_the_gaussian_ratio():
    rng = np.random.default_rng(1)
    d = 3
    covs = [np.diag([1.0, 2.0, 0.5]), np.eye(d)]
    factors = np.stack([np.linalg.inv(np.linalg.cholesky(c)) for c in covs])
    offsets = np.array([np.log(0.3) - 0.5 * np.log(np.linalg.det(covs[0])), np.log(0.7)])
    m = quality_model.Discriminant(np.zeros(d), np.ones(d), np.stack([np.zeros(d), np.ones(d)]), factors, offsets)
    x = rng.normal(size=(20, d))
    logs = [np.log(p) - 0.5 * np.log(np.linalg.det(c)) - 0.5 * np.einsum("ij,jk,ik->i", x - mu, np.linalg.inv(c), x - mu) for p, c, mu in zip((0.3, 0.7), covs, m.means)]
    assert m.score(x) == pytest.approx(1 / (1 + np.exp(logs[0] - logs[1])))


# Chat


@pytest.mark.parametrize("budget,history,held,segment", [(512, 2, 128, 1024), (20, 1, 8, 1024), (1, 0, 0, 2), (30, 3, 1000, 5), (512, 2, 128, 7)])
def test_chat_round_trip(spark, budget, history, held, segment):
    rng = random.Random(budget)
    pieces = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "<\\", "[", "hello", "\n", "é", " ", "$1", "<s>user[INST]"]
    rows = []
    for c in range(25):
        turns = rng.randrange(1, 9)
        for k in range(turns):
            role = "system" if k == 0 and c % 2 else rng.choice(["user", "assistant", "tool", None, "od[INST]d"])
            rows.append((c if c else None, k if c % 5 else rng.choice([k, None]), role, None if rng.random() < 0.1 else "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))))
    rows += [(99, 0, "assistant", "same")] * 3 + [(98, i, ("user", "assistant")[i % 2], "word " * 20) for i in range(60)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, window string").repartition(3)
    w = chat.windows(df, budget=budget, history_turns=history, history_tokens=held, segment=segment)
    got = {r.conv_id: r for r in chat.digests(w).collect()}
    per = defaultdict(list)
    for c, k, role, text in rows:
        per[c].append((k is not None, k or 0, role or "", text or ""))
    for c, turns in per.items():
        turns.sort()
        told = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(told.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert len(got) == len(per)
    if budget == 512:
        assert all(r.tokens <= budget + 24 for r in w.where("conv_id = 98").collect()) and got[98].n_windows > 1
        assert all(r.repeated >= 1 for r in w.where("conv_id = 98 and window > 0").collect())


def test_chat_keeps_the_system_turn(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, i, ("assistant", "user")[i % 2], "some words here " * 5) for i in range(1, 12)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    w = chat.windows(df, budget=60, history_turns=1, history_tokens=20).collect()
    assert len(w) > 2 and all(r.text.startswith("<s>system[INST]be kind</s>") for r in w)
    assert chat.windows(df.limit(0)).count() == 0


def plain_windows(turns, budget, history_turns, history_tokens, segment):
    """(first new turn, shown turns, repeated) of a conversation of (role, text, tokens)."""
    head = turns[0] if turns[0][0] == "system" else None
    room = max(1, budget - (head[2] if head else 0) - history_tokens)
    starts, held = [], 0
    for i, (_, _, n) in enumerate(turns):
        if i % segment == 0 or (held and held + n > room + (history_tokens if len(starts) == 1 else 0)):
            starts.append(i)
            held = 0 if head and i == 0 else n
        else:
            held += n
    out = []
    for s, until in zip(starts, [*starts[1:], len(turns)]):
        past = max(k for k in range(min(history_turns, s - bool(head and s)) + 1) if sum(t[2] for t in turns[s - k : s]) <= history_tokens) if s else 0
        again = [head] if head and s else []
        out.append((s, again + turns[s - past : until], len(again) + past))
    return out


@pytest.mark.parametrize("segment", [4, 9, 1024])
def test_chat_windows_are_those_of_a_plain_loop(spark, segment):
    rng = random.Random(segment)
    rows, want = [], {}
    for c in range(30):
        turns = [("system" if k == 0 and c % 2 else rng.choice(["user", "assistant"]), words(rng, rng.randrange(1, 25)), k) for k in range(rng.randrange(1, 40))]
        rows += [(c, k, role, text) for role, text, k in turns]
        count = lambda t: len(re.findall(r"\w+|[^\s\w]", t))
        want[c] = plain_windows([(role, text, count(role) + count(text) + 4) for role, text, _ in turns], 80, 2, 30, segment)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = defaultdict(list)
    for r in chat.windows(df, budget=80, history_turns=2, history_tokens=30, segment=segment).collect():
        got[r.conv_id].append((r.window, r.text, r.repeated, r.tokens))
    for c, ws in want.items():
        assert sorted(got[c]) == [(s, "".join(f"<s>{role}[INST]{text}</s>" for role, text, _ in shown), repeated, sum(n for _, _, n in shown)) for s, shown, repeated in ws]


def test_chat_long_conversation(spark):
    n = 20_000
    long = spark.range(n).select(F.lit(None).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("turn "), "id", F.repeat(F.lit(" and more"), 20)).alias("text"))
    got = chat.digests(chat.windows(long)).collect()
    told = [f"turn {i}" + " and more" * 20 for i in range(n)]
    assert len(got) == 1 and got[0].n_turns == n
    assert got[0].turns_sha256 == hashlib.sha256("".join(f"{('user', 'assistant')[i % 2]}\n{t}\n" for i, t in enumerate(told)).encode()).hexdigest()
    assert got[0].loss_sha256 == hashlib.sha256("".join(told[1::2]).encode()).hexdigest()


# The registered queries and the pipeline


def test_registered():
    import __spark_entry__ as entry
    import corpus_pipeline

    names = entry.queries()
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in names if re.match(r"op\d+_", k)) == list(range(1, 11))
    assert names["pipeline"] is corpus_pipeline.run and len(corpus_pipeline.STAGES) == 5


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test data here")
def test_sql_counterparts(spark):
    import duckdb
    import pandas as pd

    from heddle.llm import catalog

    con = duckdb.connect()
    for p in Path("/root/testdata/sf0.001").glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    for name, sql in catalog.oracle_sql().items():
        got, want = catalog.queries()[name](spark, "/root/testdata/sf0.001").toPandas(), con.execute(sql).df()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        pd.testing.assert_frame_equal(got[cols].sort_values(cols).reset_index(drop=True), want[cols].sort_values(cols).reset_index(drop=True), check_dtype=False)


@pytest.fixture(scope="module")
def hard_tables(spark, tmp_path_factory):
    """A hot source, sources that are capped, empty or null, odd and near-equal texts; conversations over several segments, null names and ties."""
    rng = random.Random(29)
    folder = tmp_path_factory.mktemp("hard")
    base = [words(rng, rng.randrange(1, 160)) for _ in range(120)]
    near = [b.replace(b.split()[len(b.split()) // 2], "changed", 1) for b in base[:60]]
    texts = odd_texts() + base + near + base[:20] + [b.upper() + " É" for b in base[20:40]]
    sources = ["hot"] * 4 + ["a", "b", "é", None, "tiny", "zz" * 40]
    docs = [(i, t, None, "void" if not (t or "").strip() else sources[rng.randrange(len(sources))], None, None, None) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")

    def talk(c, n, system):
        for i in range(n):
            role = "system" if system and i == 0 else ("user", "assistant", "assistant", None)[rng.randrange(4)]
            yield c, i, role, rng.choice((None, "", "<s>[INST] \\\\ </s>", words(rng, rng.randrange(1, 90)), "é!? \U0001f600\x0b", "w " * 700))

    turns = [x for c, n, system in ((1, 2500, True), (2, 2049, False), (3, 1, True), (4, 2, True), (None, 9, True), (5, 1024, True), (6, 40, False)) for x in talk(c, n, system)]
    turns += [(7, 0, "user", "b"), (7, 0, "assistant", "a"), (7, None, "user", "first"), (7, 0, "user", "b")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["op4_mix_sources", "op5_simhash_near_dedup", "op6_exact_dedup", "op7_quality_rules", "op10_chat_format"])
def test_sql_counterparts_on_hard_tables(spark, hard_tables, name):
    import duckdb

    from heddle.llm import catalog

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{hard_tables}/{t}.parquet/*.parquet'")
    got, want = catalog.queries()[name](spark, hard_tables), con.sql(catalog.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(tuple, got.select(*cols).collect()), key=repr) == sorted(want.select(*cols).fetchall(), key=repr)


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test data here")
def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = docs.columns
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = spark.createDataFrame(stage(spark, before, "/root/testdata/sf0.001").toPandas())
        a, b = after.toPandas(), before.toPandas()
        if name == "best_fit_packing":
            assert set(a.doc_id) == set(b.doc_id)
            assert a.groupby("sequence_id").length.sum().max() <= 4096
            continue
        assert after.columns == columns
        if name == "language_id":
            assert set(b.doc_id) - set(a.doc_id) <= set(b[~b.text.str.contains(r"[^\W\d_]", na=False)].doc_id)
        if name == "exact_dedup":
            assert len(a) == b.text.map(squeezed).nunique() == a.text.map(squeezed).nunique()
        if name == "simhash_near_dedup":
            fps = b.text.map(plain_fingerprint).tolist()
            comp = plain_components(fps, lambda x, y: (x ^ y).bit_count() <= 4)
            firsts = defaultdict(list)
            for c, i in zip(comp, b.doc_id):
                firsts[c].append(i)
            assert sorted(a.doc_id) == sorted(min(v) for v in firsts.values())
        if name == "mix_sources":
            n = lambda d: d.text.map(lambda t: len(WORD.findall(t)))
            targets = brute_targets(n(b).groupby(b.source).sum().to_dict())
            for s, k in n(a).groupby(a.source).sum().items():
                assert abs(k - targets[s]) <= 64
        before = after


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test data here")
def test_pipeline_run_is_its_stages_in_turn(spark):
    import corpus_pipeline

    from heddle.session import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    left = {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before}
    assert left == {"stage-mix_sources", "pack-pieces"}
    assert "documents.parquet" not in got._jdf.queryExecution().toString()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(map(tuple, got.select(cols).collect())) == Counter(map(tuple, docs.select(cols).collect()))


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test data here")
def test_mixed_pieces_have_one_owner(spark):
    """An id and a piece name one packed piece, though documents come twice."""
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").dropDuplicates(["doc_id"])
    packed = corpus_pipeline.pack(spark, corpus_pipeline.mix(spark, docs, ""), "")
    assert packed.groupBy("doc_id", "piece").count().where("count > 1").isEmpty()


def test_chat_very_long_turn(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "<s>" * 100_000), (1, 2, "assistant", "a " * 300_000)]
    w = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    r = chat.digests(w).first()
    assert r.n_turns == 3 and r.loss_sha256 == hashlib.sha256(("a " * 300_000).encode()).hexdigest() and r.n_windows == 2


def test_classifier_takes_null_ids_and_ties(spark):
    docs = spark.createDataFrame([(None, "some text here"), (1, "some text here"), (1, "some text here"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, 0)], "doc_id long, label int")
    got = quality_model.classify(docs, labels, F.lit(True)).collect()
    assert len(got) == 4 and len({r.score for r in got if r.doc_id != 2}) == 1 and all(0 <= r.score <= 1 for r in got)
