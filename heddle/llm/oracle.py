"""DuckDB SQL for the corpus queries that SQL can express."""

SQL: dict[str, str] = {}

SQL["op6_exact_dedup"] = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS sha
  FROM documents),
r AS (
  SELECT *, row_number() OVER (PARTITION BY sha ORDER BY n DESC, doc_id) AS place,
         first_value(doc_id) OVER (PARTITION BY sha ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY sha) AS group_size
  FROM t)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha AS text_sha256 FROM r
"""

SQL["op7_quality_rules"] = r"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM t),
g AS (
  SELECT rid, i, [words[i], words[i + 1], words[i + 2]] AS gram
  FROM w, LATERAL (SELECT unnest(range(1, len(words) - 1)) AS i)),
twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1),
covered AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS v(k) GROUP BY rid),
c AS (
  SELECT w.rid, doc_id, text, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines,
         length(text) - length(regexp_replace(text, '\p{L}', '', 'g')) AS letters,
         length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')) AS capitals,
         length(text) - length(regexp_replace(text, '!', '', 'g')) AS shouts
  FROM w LEFT JOIN covered USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words
            OR n_symbols > 0.3::DOUBLE * n_words
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR n_dup_lines > 0.5::DOUBLE * n_lines
            OR (letters > 0 AND capitals > 0.5::DOUBLE * letters)
            OR shouts > 0.5::DOUBLE * n_words
            OR word_chars - letters > 0.5::DOUBLE * word_chars) AS kept
FROM c
"""


# XXH64 in 128-bit integers. A rotation by r is a product with 2^r modulo 2^64 - 1, a product modulo 2^64 is cut to 64 bits.
_P = ("11400714785074694791", "14029467366897019727", "1609587929392839161", "9650029242287828579", "2870177450012600261")
_P1, _P2, _P3, _P4, _P5 = (f"{p}::UHUGEINT" for p in _P)
_M = "18446744073709551616::UHUGEINT"


def _cut(x: str) -> str:
    return f"(({x}) % {_M})"


def _times(x: str, p: str) -> str:
    return _cut(f"({x}) * {p}")


def _turned(x: str, r: int) -> str:
    return f"((({x}) * {1 << r}::UHUGEINT) % 18446744073709551615::UHUGEINT)"


def _round(x: str) -> str:
    return _times(_turned(_times(x, _P2), 31), _P1)


def _eight(h: str, k: str) -> str:
    return _cut(f"{_turned(f'xor({h}, {_round(k)})', 27)} * {_P1} + {_P4}")


def _four(h: str, k: str) -> str:
    return _cut(f"{_turned(f'xor({h}, {_times(k, _P1)})', 23)} * {_P2} + {_P3}")


def _one(h: str, k: str) -> str:
    return _times(_turned(f"xor({h}, {_times(k, _P5)})", 11), _P1)


def _last(h: str) -> str:
    for shift, p in ((33, _P2), (29, _P3), (32, None)):
        h = f"list_transform([{h}], lambda v: xor(v, v >> {shift}))[1]"
        h = _times(h, p) if p else h
    return h


def _xxh64(text: str, seed: str) -> str:
    """SQL for the XXH64 of a string's UTF-8 bytes, as UHUGEINT; ``text`` and ``seed`` are named more than once."""
    number = lambda at, n: "('0x' || " + " || ".join(f"substr(hex({text}), 2 * ({at}) + {2 * i + 1}, 2)" for i in reversed(range(n))) + ")::UBIGINT::UHUGEINT"
    n = f"strlen({text})"
    lanes = [f"list_reduce(list_transform(range({n} // 32), lambda i: {number(f'32 * i + {8 * j}', 8)}), lambda a, k: {_times(_turned(_cut(f'a + {_times("k", _P2)}'), 31), _P1)}, {start})"
             for j, start in enumerate((_cut(f"{seed} + {_P1} + {_P2}"), _cut(f"{seed} + {_P2}"), f"({seed})", _cut(f"{seed} + {_M} - {_P1}")))]
    merged = _cut(" + ".join(_turned(f"l[{j + 1}]", r) for j, r in enumerate((1, 7, 12, 18))))
    for j in range(4):
        merged = _cut(f"xor({merged}, {_round(f'l[{j + 1}]')}) * {_P1} + {_P4}")
    start = f"CASE WHEN {n} >= 32 THEN list_transform([[{', '.join(lanes)}]], lambda l: {merged})[1] ELSE {_cut(f'{seed} + {_P5}')} END"
    h = _cut(f"{start} + {n}::UHUGEINT")
    h = f"list_reduce(list_transform(range(({n} % 32) // 8), lambda i: {number(f'{n} - {n} % 32 + 8 * i', 8)}), lambda a, k: {_eight('a', 'k')}, {h})"
    h = f"list_reduce(list_transform(range(({n} % 8) // 4), lambda i: {number(f'{n} - {n} % 8', 4)}), lambda a, k: {_four('a', 'k')}, {h})"
    h = f"list_reduce(list_transform(range({n} % 4), lambda i: {number(f'{n} - {n} % 4 + i', 1)}), lambda a, k: {_one('a', 'k')}, {h})"
    return _last(h)


def _long_hash(value: str, seed: str) -> str:
    """XXH64 of an integer of eight bytes that is not negative."""
    return _last(_eight(_cut(f"{seed} + {_P5} + 8"), f"({value})::UHUGEINT"))


def _int_hash(value: str, seed: str) -> str:
    return _last(_four(_cut(f"{seed} + {_P5} + 4"), f"({value})::UHUGEINT"))


SQL["op5_simhash_near_dedup"] = rf"""
WITH RECURSIVE t AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT rid, array_to_string(w[i:i + 3], ' ') AS shingle
  FROM t, LATERAL (SELECT unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i) WHERE len(w) > 0),
d AS MATERIALIZED (SELECT shingle, ({_xxh64('shingle', '42::UHUGEINT')})::UBIGINT AS h FROM (SELECT DISTINCT shingle FROM s)),
f AS MATERIALIZED (
  SELECT rid, {' + '.join(f"CASE WHEN 2 * sum((h >> {b}) & 1) > count(*) THEN {1 << b}::UBIGINT ELSE 0::UBIGINT END" for b in range(64))} AS fp
  FROM s JOIN d USING (shingle) GROUP BY rid),
r AS MATERIALIZED (SELECT doc_id, coalesce(fp, 0::UBIGINT) AS fp FROM t LEFT JOIN f USING (rid)),
v AS MATERIALIZED (SELECT fp, min(doc_id) AS first_id FROM r GROUP BY fp),
e AS MATERIALIZED (SELECT x.fp AS a, y.fp AS b FROM v x JOIN v y ON bit_count(xor(x.fp, y.fp)::HUGEINT) <= 4),
reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
c AS (SELECT a AS fp, min(first_id) AS component_id FROM reach JOIN v ON reach.b = v.fp GROUP BY a)
SELECT doc_id, printf('%016x', fp) AS fingerprint, component_id FROM r JOIN c USING (fp)
"""

# The targets by the closed form, all quotients ranked one by one, then the words of each block a document has.
_HASH_17, _HASH_18 = _int_hash("17", "42::UHUGEINT"), _int_hash("18", "42::UHUGEINT")
SQL["op4_mix_sources"] = rf"""
WITH k AS MATERIALIZED (SELECT {_HASH_17} AS k17, {_HASH_18} AS k18),
t AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         greatest(256, count(*) OVER () // 50000) AS buckets
  FROM documents),
h AS MATERIALIZED (
  SELECT rid, doc_id, source, size, {_long_hash('doc_id', 'k17')} AS spot, buckets,
         ({_long_hash('doc_id', 'k18')} + {_M} // 2) % {_M} AS turn
  FROM t, k),
b AS (
  SELECT *, (((spot::HUGEINT - CASE WHEN spot >= {_M} // 2 THEN 18446744073709551616::HUGEINT ELSE 0::HUGEINT END) % buckets + buckets) % buckets) AS bucket FROM h),
placed AS MATERIALIZED (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY bucket, turn, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM b),
n AS (
  SELECT source, sum(size)::BIGINT AS n, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM t GROUP BY source),
filled AS (
  SELECT *, sum(n) OVER () AS all_n, sum(w) OVER () AS all_w,
         coalesce(sum(n) OVER fill, 0) AS full_n, coalesce(sum(w) OVER fill, 0) AS full_w, row_number() OVER (ORDER BY n / w, source NULLS LAST) AS place
  FROM n WINDOW fill AS (ORDER BY n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
offered AS (SELECT *, (3 * all_n - 4 * full_n)::DOUBLE AS top, (2 * (all_w - full_w))::DOUBLE AS bottom FROM filled),
level AS (SELECT arg_min(top, place) AS top, arg_min(bottom, place) AS bottom FROM offered WHERE w::DOUBLE * top / bottom <= 2 * n),
targets AS MATERIALIZED (
  SELECT source, n, ceil(n / 32)::BIGINT AS blocks, coalesce(least(w::DOUBLE * level.top / level.bottom, (2 * n)::DOUBLE), (2 * n)::DOUBLE) AS target FROM offered, level),
seats AS (SELECT *, CASE WHEN n > 0 THEN target * blocks / n ELSE 0 END AS due FROM targets),
won AS MATERIALIZED (
  SELECT source, count(*) AS quota FROM (
    SELECT source, row_number() OVER (ORDER BY due / (2 * q + 1) DESC, q, source NULLS LAST) AS place
    FROM seats, LATERAL (SELECT unnest(range(0, 2 * blocks)) AS q))
  WHERE place <= (SELECT round(sum(due))::BIGINT FROM seats) GROUP BY source),
shards AS (
  SELECT s.source, shard, run, quota, least(run, blocks - shard * run) AS held
  FROM (SELECT *, greatest(1024, ceil(blocks / 1024)::BIGINT) AS run FROM targets) s JOIN won ON s.source IS NOT DISTINCT FROM won.source,
       LATERAL (SELECT unnest(range(0, (blocks - 1) // run + 1)) AS shard)),
held AS MATERIALIZED (
  SELECT s.source, s.shard, any_value(run) AS run, any_value(held) AS held, count(*) FILTER (place <= quota) AS quota FROM (
    SELECT source, shard, run, held, quota, row_number() OVER (PARTITION BY source ORDER BY held / (2 * q + 1) DESC, q, shard) AS place
    FROM shards, LATERAL (SELECT unnest(range(0, 2 * held)) AS q)) s
  GROUP BY s.source, s.shard),
salted AS MATERIALIZED (
  SELECT held.*, CASE WHEN source IS NULL THEN k17 ELSE {_xxh64('source', 'k17')} END AS salt FROM held, k),
turned AS MATERIALIZED (
  SELECT *, ((h::HUGEINT - CASE WHEN h >= {_M} // 2 THEN 18446744073709551616::HUGEINT ELSE 0::HUGEINT END) % held + held) % held AS turn
  FROM (SELECT *, {_long_hash('shard', 'salt')} AS h FROM salted)),
words AS (
  SELECT rid, source, least(start + size, 32 * (block + 1)) - greatest(start, 32 * block) AS n, block
  FROM placed, LATERAL (SELECT unnest(range(start // 32, (start + size - 1) // 32 + 1)) AS block) WHERE size > 0),
taken AS (
  SELECT rid, sum(words.n * (quota // held + CASE WHEN ((block - shard * run - turn) % held + held) % held < quota % held THEN 1 ELSE 0 END)) AS taken
  FROM words JOIN turned ON words.source IS NOT DISTINCT FROM turned.source AND block // run = shard GROUP BY rid)
SELECT doc_id, size, targets.n AS source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM placed JOIN targets ON placed.source IS NOT DISTINCT FROM targets.source LEFT JOIN taken USING (rid)
"""

# Windows one turn after the other: a segment of 1,024 turns starts anew, otherwise a turn that no longer fits does.
SQL["op10_chat_format"] = r"""
WITH RECURSIVE said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS MATERIALIZED (
  SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i,
         (len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\t\n\x0B\f\r \p{L}\p{N}]')) + len(regexp_extract_all(role, '[\p{L}\p{N}]+|[^\t\n\x0B\f\r \p{L}\p{N}]')) + 4)::BIGINT AS tokens,
         13 + length(regexp_replace(role, '[<\[\\]', '..', 'g')) + length(regexp_replace(text, '[<\[\\]', '..', 'g')) AS points
  FROM said),
heads AS MATERIALIZED (
  SELECT c, role = 'system' AS has, CASE WHEN has THEN tokens ELSE 0 END AS tokens, CASE WHEN has THEN points ELSE 0 END AS points FROM t WHERE i = 0),
walk AS (
  SELECT t.c, i, CASE WHEN has THEN 0 ELSE t.tokens END AS held, true AS starts, 1 AS n, greatest(1, 512 - heads.tokens - 128) AS room
  FROM t JOIN heads USING (c) WHERE i = 0
  UNION ALL
  SELECT c, i, CASE WHEN fresh THEN tokens ELSE held + tokens END, fresh, n + CASE WHEN fresh THEN 1 ELSE 0 END, room
  FROM (
    SELECT t.c, t.i, held, t.tokens, n, room,
           t.i % 1024 = 0 OR (held > 0 AND held + t.tokens > room + CASE WHEN n = 1 THEN 128 ELSE 0 END) AS fresh
    FROM walk JOIN t ON t.c = walk.c AND t.i = walk.i + 1)),
opened AS (
  SELECT w.c, n, CASE WHEN n = 1 THEN 0 ELSE heads.points END + CASE WHEN n = 1 THEN 0
           WHEN b.points IS NOT NULL AND a.tokens + b.tokens <= 128 THEN a.points + b.points
           WHEN a.tokens <= 128 THEN a.points ELSE 0 END AS again
  FROM walk w JOIN heads USING (c)
  LEFT JOIN t a ON a.c = w.c AND a.i = w.i - 1 AND NOT (has AND a.i = 0)
  LEFT JOIN t b ON b.c = w.c AND b.i = w.i - 2 AND NOT (has AND b.i = 0)
  WHERE starts),
shown AS (SELECT c, sum(again) AS again, count(*) AS n_windows FROM opened GROUP BY c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(points) + any_value(again))::BIGINT AS formatted_chars, any_value(n_windows) AS n_windows
FROM t JOIN shown USING (c) GROUP BY conv_id
"""
