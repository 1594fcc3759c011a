"""Secret scans: keyword and key patterns, plus character Markov models.

Two first-order Markov models over characters, one of random strings and one of
ordinary identifiers, are counted from labelled samples. A run of key
characters is a secret where its log-likelihood ratio speaks for the random
model. The ratio of each character pair is kept as an integer, so a score is an
exact sum on any engine and any partitioning.

Positions come from the gaps that ``split`` leaves and the matches that
``regexp_extract_all`` finds, so a scan stays inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import sampled, text_of

#: kind -> (pattern, the part whose length counts, least length). In the order in which spans of one start are listed.
BASE = {
    "assign": (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: What can be a key: runs of these characters, at least LEAST long.
KEY = r"[A-Za-z0-9+/_=-]{16,}"
LEAST = 16
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Hundredths of a nat: a run is random from this ratio in all, and from this ratio for each pair.
LEAST_TOTAL, LEAST_PAIR = 800, 40
#: About how many documents have their words stand for ordinary identifiers, and the number of random strings of each form.
SAMPLE_ROWS, RANDOM_STRINGS = 1000, 2000
#: Characters that people type in this order.
IN_ORDER = ("abcdefghijklmnopqrstuvwxyz", "qwertyuiopasdfghjklzxcvbnm", "0123456789")
#: Words of ordinary identifiers: what the models know where the documents hold few.
ORDINARY = """account action active address agent alias amount append archive array article asset async attribute author backup balance batch block body buffer build
button cache callback cancel category channel check child class client cluster code collection color column command comment commit common component config connection container
content context control controller copy count country create current customer data database date debug default delete description detail device directory display document domain
download duration edge edit email enable encode engine entity entry environment error event example exception execute export factory feature field file filter final find flag
folder format frame function gateway global graph group handler hash header height helper history host identifier image import index initial input insert instance integer interface
internal invoice item iterator job join kernel key label language layer layout length level library license limit line link list listener load local location logger login main
manager mapping master matrix member memory menu message method metric model module monitor name network node normal notification number object offset operation option order output
owner package page panel parameter parent parser password patch path pattern payment permission pipeline plugin pointer policy pool port position prefix price primary process
product profile project property protocol provider public query queue random range reader record reference region register release remote render report repository request reset
resource response result return role root route row rule runtime sample schedule schema scope script search secret section security select selector sender sequence server service
session setting shader shape share signal size snapshot source stack stage start state status storage stream string structure style subject submit suffix summary support symbol
system table tag target task template test text thread time title token tool total trace transaction transform tree trigger type unit update upload user util validate value variable
vector version view visible volume warning widget width window worker wrapper writer zone""".split()


def _hex_runs() -> str:
    # Shorter runs are no hits and only cost time, but a run must be whole: not preceded by a hex digit.
    return r"(?<![0-9a-f])[0-9a-f]{24,}"


def spans(text: Column, pattern: str, kind: str, part: int = 0, least: int = 1) -> Column:
    """array<struct<start, rank, until, kind, value>> of the leftmost non-overlapping matches, in code points."""
    gaps = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), 0)
    value = whole if part == 0 else F.regexp_extract_all(text, F.lit(pattern), part)
    rank = {k: i for i, k in enumerate([*BASE, "random"])}[kind]
    empty = "cast(array() as array<struct<start:int,rank:int,until:int,value:string>>)"
    parts = F.struct(gaps.alias("g"), whole.alias("m"), value.alias("v"))
    return F.when(
        text.rlike(pattern),
        F.aggregate(
            F.array(parts),
            F.expr(empty),
            lambda _, p: F.aggregate(
                F.sequence(F.lit(0), F.size(p["m"]) - 1),
                F.struct(F.lit(0).alias("at"), F.expr(empty).alias("found")),
                lambda a, i: F.struct(
                    (a["at"] + F.char_length(p["g"][i]) + F.char_length(p["m"][i])).alias("at"),
                    F.when(
                        F.char_length(p["v"][i]) >= least,
                        F.concat(a["found"], F.array(F.struct(
                            (a["at"] + F.char_length(p["g"][i])).alias("start"), F.lit(rank).alias("rank"),
                            (a["at"] + F.char_length(p["g"][i]) + F.char_length(p["m"][i])).alias("until"), p["v"][i].alias("value")))),
                    ).otherwise(a["found"]).alias("found"),
                ),
                lambda a: a["found"],
            ),
        ),
    ).otherwise(F.expr(empty))


def labelled_samples(spark: SparkSession, docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(token, label): 1 for random strings, 0 for ordinary identifiers.

    Random strings are digests written in hexadecimal and base 64, whole and in
    capitals. Ordinary identifiers are ORDINARY words in a hashed order and
    words of about ``rows`` documents, alone and joined as people join them,
    plus numbers and runs of one character, which fill places in examples.
    """
    ids = spark.range(RANDOM_STRINGS).select(F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("h"))
    b64 = F.regexp_replace(F.base64(F.unhex("h")), "=", "")
    random = ids.select(F.explode(F.array(F.substring("h", 1, 40), b64, F.upper(b64), F.regexp_replace(b64, "[+/]", ""))).alias("token"))
    # Cases mixed inside a word and long words are what secrets look like: those don't teach the ordinary model.
    words = F.filter(F.split(F.regexp_replace(text_of(), r"[^A-Za-z]+", " "), " "), lambda w: w.rlike("^([A-Z]?[a-z]{2,11}|[A-Z]{3,12})$"))
    listed_words = F.split(F.lit(" ".join(ORDINARY)), " ")
    shuffled = spark.range(20).select("id", listed_words.alias("l")).select(F.expr("transform(array_sort(transform(l, x -> struct(xxhash64(id, x) as h, x as x))), s -> s.x)").alias("w"))
    ordinary = sampled(docs.select("doc_id", "text"), rows).select(words.alias("w")).where("size(w) > 3").unionByName(shuffled)
    joined = """flatten(transform(sequence(0, size(w) - 4, 4), i -> array(
        w[i], concat(w[i], w[i + 1]), concat(lower(w[i]), '_', lower(w[i + 1]), '_', lower(w[i + 2])), concat(upper(w[i]), '_', upper(w[i + 1])),
        concat(w[i], '-', w[i + 1], '-', cast(pmod(hash(w[i]), 2030) as string)), concat('/', w[i], '/', w[i + 1], '/', w[i + 2]),
        concat(w[i], initcap(w[i + 1]), initcap(w[i + 3])), cast(pmod(xxhash64(w[i], w[i + 1]), 10000) as string), repeat(substr('-_=+/', pmod(hash(w[i + 2]), 5) + 1, 1), 20))))"""
    ordinary = ordinary.select(F.explode(F.expr(joined)).alias("token"))
    digits = spark.range(RANDOM_STRINGS).select(F.substring(F.regexp_replace(F.sha2(F.concat(F.lit("n"), "id").cast("binary"), 256), "[a-f]", ""), 1, 16).alias("token"))
    digits = digits.select(F.explode(F.array("token", F.regexp_replace("token", "([0-9]{2})", "$1-"))).alias("token"))
    runs = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in IN_ORDER])).alias("x")).select(F.explode(F.array(F.expr("repeat(x, 1000)"), F.expr("repeat(upper(x), 1000)"), F.expr("repeat(reverse(x), 100)"))).alias("token"))
    fillers = spark.range(1).select(F.explode(F.split(F.lit(ALPHABET), "")).alias("x")).where("x <> ''").select(F.expr("repeat(x, 200)").alias("token"))
    return random.select("token", F.lit(1).alias("label")).unionByName(ordinary.unionByName(digits).unionByName(runs).unionByName(fillers).select("token", F.lit(0).alias("label")))


def train(samples: DataFrame) -> list[int]:
    """128 x 128 integers, row-major by ASCII code: hundredths of a nat for random over ordinary.

    The table has one cell for each pair of alphabet characters, whatever the
    number of samples; add-one smoothing. Pairs outside the alphabet score 0.
    """
    pairs = samples.where("token is not null").select("label", F.explode(F.expr("filter(transform(sequence(1, greatest(1, char_length(token) - 1)), i -> substr(token, i, 2)), p -> char_length(p) = 2)")).alias("pair"))
    seen = pairs.groupBy("label", F.substring("pair", 1, 1).alias("a"), F.substring("pair", 2, 1).alias("b")).agg(F.count("*").alias("n"))
    letters = samples.sparkSession.range(1).select(F.explode(F.split(F.lit(ALPHABET), "")).alias("x")).where("x <> ''")
    grid = letters.select(F.col("x").alias("a"), F.explode(F.split(F.lit(ALPHABET), "")).alias("b")).where("b <> ''")
    of = lambda k: seen.where(F.col("label") == k).select("a", "b", F.col("n").alias(f"n{k}"))
    full = grid.join(of(1), ["a", "b"], "left").join(of(0), ["a", "b"], "left").na.fill(0)
    sums = full.groupBy(F.col("a").alias("s")).agg(F.sum("n1").alias("s1"), F.sum("n0").alias("s0"))
    size = len(ALPHABET)
    odds = F.log(F.col("n1") + 1) - F.log(F.col("s1") + size) - F.log(F.col("n0") + 1) + F.log(F.col("s0") + size)
    cells = full.join(sums, F.col("a") == F.col("s")).select((F.ascii("a") * 128 + F.ascii("b")).alias("at"), F.round(100 * odds).cast("int").alias("w"))
    table = [0] * (128 * 128)
    for at, w in cells.collect():  # one row for each pair of alphabet characters
        table[at] = w
    return table


def _score(token: Column, weights: Column) -> Column:
    code = lambda i: F.ascii(F.substring(token, i, F.lit(1)))
    return F.aggregate(F.sequence(F.lit(1), F.char_length(token) - 1), F.lit(0), lambda s, i: s + F.get(weights, code(i) * 128 + code(i + 1)))


def scan(docs: DataFrame, table: list[int] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base (array), found (array of all spans).

    Whole texts are scanned, null as empty. Base spans always stay; a run of
    key characters is added as ``random`` where the models say so and no base
    span overlaps it. Spans are in code points, end exclusive, by start and
    then kind. Without ``table`` the models are trained on ``docs``. Repeated
    rows give equal rows; an empty table none; other columns are ignored.
    """
    if table is None:
        table = train(labelled_samples(docs.sparkSession, docs))
    weights = F.expr(f"cast(split('{','.join(map(str, table))}', ',') as array<int>)")
    rows = docs.select("doc_id", text_of().alias("text"))
    pattern = {k: _hex_runs() if k == "hex" else p for k, (p, _, _) in BASE.items()}
    rows = rows.select("doc_id", "text", *[spans(F.col("text"), pattern[k], k, part, least).alias(f"f_{k}") for k, (_, part, least) in BASE.items()], spans(F.col("text"), KEY, "random", 0, LEAST).alias("f_runs"))
    base = F.sort_array(F.concat(*[F.col(f"f_{k}") for k in BASE]))
    rows = rows.withColumn("base", base)
    free = lambda r: ~F.exists("base", lambda b: (b["start"] < r["until"]) & (r["start"] < b["until"]))
    ratio = lambda r: _score(r["value"], weights)
    random = F.filter("f_runs", lambda r: free(r) & (F.greatest(F.lit(LEAST_TOTAL), LEAST_PAIR * (F.char_length(r["value"]) - 1)) <= ratio(r)))
    rows = rows.withColumn("found", F.sort_array(F.concat("base", random)))
    return rows.select("doc_id", *[F.size(f"f_{k}").cast("long").alias(f"n_{k}") for k in BASE], "base", "found")


def listed(found: str) -> Column:
    kinds = F.array(*[F.lit(k) for k in (*BASE, "random")])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", kinds[s["rank"]], s["start"].cast("string"), s["until"].cast("string"))), ",")


def report(docs: DataFrame, table: list[int] | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    s = scan(docs, table)
    return s.select("doc_id", *[f"n_{k}" for k in BASE], F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("found").alias("spans"))
