"""Near-duplicate lines: an exact set-similarity join in DataFrame functions only.

Lines that are equal after lower-casing and squeezing white space are one class, named by its first place (document,
line number). The distinct words of a class are its tokens, in one global order from rare to frequent: words of all lines are
counted in 2**bits hash buckets, which stay small whatever the vocabulary. Two classes with Jaccard >= num / den share a
token among the first n - ceil(num n / den) + 1 of each, so those prefixes are joined on tokens. Inside that join a pair is cut

- by length and position: what follows the first shared token on either side must hold the overlap needed,
- by 256 bits of each class, one for each token: every bit that differs is a token that is not shared;

neither ever cuts a similar pair. What is left, mostly similar pairs, is verified on the words. A line goes if an equal or similar line
stands earlier.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscope.llm.common import LOWER_AZ, UPPER, lower_az, materialize, table

#: Numbers of classes that a broadcast may hold (one long each); more of them are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Classes with one token in their prefix from which they are first compared with the earliest of them.
CROWD = 256
#: Ranks of words: steps of a factor 2**(1/4) in their counts.
STEPS, MOST_RANK = 4, 127
#: Tokens are joined in so many rounds, which divides the disk that the shuffle of all prefixes takes.
ROUNDS = 4
#: Words of 64 bits that tell the tokens of a class (a power of 2), and their columns.
WORDS = 4
MARKS = [f"bits{i}" for i in range(WORDS)]
_ODD_SPACE = ("  ", "\t", "\r", "\x0b", "\f", "\n")


def normal(line: Column) -> Column:
    """A-Z lower-cased, runs of white space as one space, none at the ends."""
    odd = F.lit(False)
    for space in _ODD_SPACE:
        odd = odd | F.contains(line, F.lit(space))
    return F.trim(F.when(odd, F.regexp_replace(lower_az(line), r"\s+", " ")).otherwise(lower_az(line)))


def all_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line of every line; a null text has none, an empty one has one empty line."""
    return docs.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, norm and key1, key2 (128 bits of norm) of every line, and line."""
    lines = all_lines(docs).withColumn("norm", normal(F.col("line")))
    return lines.withColumns({"key1": F.xxhash64("norm"), "key2": F.xxhash64(F.lit(1), "norm")})


def _is_blank() -> Column:
    """Of rows with key1, key2: whether norm is empty, told without reading it."""
    return (F.col("key1") == F.xxhash64(F.lit(""))) & (F.col("key2") == F.xxhash64(F.lit(1), F.lit("")))


def word_ranks(lines: DataFrame, bits: int) -> list[int]:
    """For each of 2**bits hash buckets of words: 1 to MOST_RANK, rising with the number of words of all lines(norm) in it."""
    words = lines.where("norm <> ''").select(F.explode(F.split("norm", " ")).alias("word"))
    counts = words.groupBy(F.xxhash64("word").bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias("bucket")).count()
    ranks = [1] * (1 << bits)
    for bucket, rank in counts.select("bucket", F.least(F.lit(MOST_RANK), 1 + F.floor(STEPS * F.log2("count"))).cast("int")).collect():  # one row a bucket
        ranks[bucket] = rank
    return ranks


def _tokens(words: Column, ranks: list[int], bits: int) -> Column:
    """One number a distinct word, sorted from rare to frequent: the rank of the word's bucket, then 56 bits of its hash."""
    first = F.from_json(F.lit(json.dumps(ranks)), "array<tinyint>")  # small numbers: the driver keeps the text of each plan
    rank = lambda h: F.shiftleft(F.get(first, h.bitwiseAND(F.lit((1 << bits) - 1)).cast("int")).cast("long"), 56)
    hashes = F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))
    return F.sort_array(F.transform(hashes, lambda h: rank(h).bitwiseOR(F.shiftrightunsigned(h, 8))))


def _marks(tokens: Column, word: int) -> Column:
    """One of the words of 64 bits of a class: a bit for each token that falls there."""
    bit = lambda t: F.when(F.shiftright(t, 6).bitwiseAND(F.lit(WORDS - 1)) == word, F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(F.lit(63)).cast("int"))).otherwise(F.lit(0).cast("long"))
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda seen, t: seen.bitwiseOR(bit(t)))


def line_classes(keyed: DataFrame, num: int = 80, den: int = 100, bits: int = 17) -> DataFrame:
    """id, doc, line (the first place), key1, key2, n, prefix and MARKS of each class of lines that aren't blank; written.

    keyed: doc_id, line_no, norm, key1, key2. id rises with the first place; prefix holds the tokens by which a similar class is met.
    """
    lines = keyed.where(~_is_blank())
    firsts = lines.groupBy("key1", "key2").agg(F.min(F.struct("doc_id", "line_no")).alias("first")).select(F.col("first.doc_id").alias("doc"), F.col("first.line_no").alias("line"), "key1", "key2")
    firsts = materialize(firsts.sort("doc", "line", "key1", "key2").select(F.monotonically_increasing_id().alias("id"), "*"), "line-firsts")
    lines = lines.select("doc_id", "line_no", "key1", "key2", _tokens(F.split("norm", " "), word_ranks(keyed, bits), bits).alias("tokens")).withColumn("n", F.size("tokens"))
    short = F.slice("tokens", F.lit(1), F.col("n") - F.ceil(F.col("n") * num / F.lit(den)).cast("int") + 1)
    whole = lines.select("key1", "key2", F.struct("doc_id", "line_no", "n", short.alias("prefix"), *(_marks(F.col("tokens"), i).alias(m) for i, m in enumerate(MARKS))).alias("row"))
    whole = whole.groupBy("key1", "key2").agg(F.min("row").alias("row"))
    classes = whole.join(firsts, ["key1", "key2"]).select("id", "doc", "line", "key1", "key2", "row.n", "row.prefix", *(f"row.{m}" for m in MARKS))
    return materialize(classes, "line-classes")


def _may_be_similar(num: int, den: int) -> Column:
    """Whether classes a and b that share the tokens at place_a and place_b can have Jaccard num / den, as far as places and bits tell.

    If that token is the first they share, all others they share follow it. A bit that only one has is a token that the other has not.
    """
    a, b = ({c: F.col(f"{c}_{x}") for c in ("n", "place", *MARKS)} for x in "ab")
    needed = num * (a["n"] + b["n"])
    follow = (num + den) * F.least(a["n"] - a["place"], b["n"] - b["place"]) >= needed
    differ = sum(F.bit_count(a[m].bitwiseXOR(b[m])) for m in MARKS)
    return follow & ((num + den) * (a["n"] + b["n"] - differ) >= 2 * needed)


def _side(rows: DataFrame, mark: str) -> DataFrame:
    return rows.select("token", *(F.col(c).alias(f"{c}_{mark}") for c in rows.columns if c != "token"))


def _verified(pairs: DataFrame, classes: DataFrame, keyed: DataFrame, num: int, den: int) -> DataFrame:
    """The distinct id_a of pairs(id_a, id_b), written, whose words have Jaccard num / den; written."""
    ids = pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    wanted = materialize(classes.select("id", "doc", "line", "key1", "key2").join(ids, "id", "left_semi"), "line-wanted")
    same = keyed["doc_id"].eqNullSafe(wanted["doc"]) & (keyed["line_no"] == wanted["line"]) & (keyed["key1"] == wanted["key1"]) & (keyed["key2"] == wanted["key2"])
    small = wanted.count() <= BROADCAST_ROWS // 8
    words = keyed.join(F.broadcast(wanted) if small else wanted, same).select("id", F.array_distinct(F.split("norm", " ")).alias("words")).dropDuplicates(["id"])
    a, b = (words.select(F.col("id").alias(f"id_{x}"), F.col("words").alias(f"words_{x}")) for x in "ab")
    common = F.size(F.array_intersect("words_a", "words_b"))
    alike = common * (den + num) >= (F.size("words_a") + F.size("words_b")) * num
    return materialize(pairs.join(a, "id_a").join(b, "id_b").where(alike).select(F.col("id_a").alias("id")).distinct(), "line-late")


def similar_earlier(classes: DataFrame, keyed: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """id of the classes (as line_classes gives them) that have a similar class earlier."""
    def postings(of: DataFrame) -> DataFrame:
        return of.select("id", "n", *MARKS, F.posexplode("prefix").alias("place", "token"))

    def met(later: DataFrame, earlier: DataFrame) -> DataFrame:
        both = _side(later, "a").join(earlier, "token").where((F.col("id_b") < F.col("id_a")) & _may_be_similar(num, den))
        return materialize(both.select("id_a", "id_b").distinct(), "line-pairs")

    # where many classes have one token, most copies of a crowd end at its earliest class; what this leaves out is met again below
    maybe = postings(classes).where(F.shiftrightunsigned("token", 56) >= 1 + STEPS * (CROWD.bit_length() - 1))  # no rarer token has as many classes
    crowds = materialize(maybe.groupBy("token").agg(F.count("*").alias("seen"), F.min("id").alias("id")).where(F.col("seen") > CROWD).drop("seen"), "line-crowds")
    found = None
    if n_crowds := crowds.count():
        few = F.broadcast if n_crowds <= BROADCAST_ROWS // 8 else lambda df: df
        heads = materialize(maybe.join(few(crowds), ["token", "id"], "left_semi"), "line-heads")
        found = _verified(met(maybe, few(_side(heads, "b"))), classes, keyed, num, den)
    open_ = classes.join(F.broadcast(found) if found.count() <= BROADCAST_ROWS else found, "id", "left_anti") if found is not None else classes
    pairs = None
    for turn in range(ROUNDS):
        mine = F.pmod("token", F.lit(ROUNDS)) == turn
        more = met(postings(open_).where(mine), _side(postings(classes).where(mine), "b"))
        pairs = more if pairs is None else pairs.union(more)
    pairs = materialize(pairs.distinct(), "line-pairs")

    # most are settled by their earliest candidate, so few pairs need their words a second time
    first = materialize(pairs.groupBy("id_a").agg(F.min("id_b").alias("id_b")), "line-first-pairs")
    late = _verified(first, classes, keyed, num, den)
    rest = pairs.join(late.select(F.col("id").alias("id_a")), "id_a", "left_anti").join(first, ["id_a", "id_b"], "left_anti")
    late = late.union(_verified(materialize(rest, "line-pairs"), classes, keyed, num, den))
    return found.union(late) if found is not None else late


def line_verdicts(docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, line_no, key1, key2, blank, kept for every line: judged_lines without the lines, which are told by 128 bits."""
    keyed = materialize(_keyed(docs).drop("line"), "line-norms")
    classes = line_classes(keyed, num, den)
    stay = classes.join(similar_earlier(classes, keyed, num, den), "id", "left_anti").select("doc", "line", "key1", "key2")
    lines = keyed.select("doc_id", "line_no", "key1", "key2", _is_blank().alias("blank")).alias("lines")
    same = F.expr("lines.doc_id <=> stay.doc and lines.line_no = stay.line and lines.key1 = stay.key1 and lines.key2 = stay.key2")
    return lines.join(stay.alias("stay"), same, "left").select("lines.doc_id", "lines.line_no", "lines.key1", "lines.key2", "blank", (F.col("blank") | F.col("stay.line").isNotNull()).alias("kept"))


def judged_lines(docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, line_no, line, kept for every line. Blank lines are kept.

    A line goes if an equal or similar line stands before it. Lines of rows with a null doc_id stand first; of rows that repeat a doc_id, equal
    lines with equal numbers stay or go together, and different ones with equal numbers have a fixed order. Null texts have no lines; an
    empty table gives none. Other columns are not read.
    """
    verdicts = line_verdicts(docs, num, den).distinct().alias("told")
    same = F.expr("lines.doc_id <=> told.doc_id and lines.line_no = told.line_no and lines.key1 = told.key1 and lines.key2 = told.key2")
    return _keyed(docs).alias("lines").join(verdicts, same).select("lines.doc_id", "lines.line_no", "lines.line", "told.kept")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, kept lines, and the digest of the kept ones' numbers, comma-joined."""
    docs = table(spark, sf_dir, "documents")
    out = line_verdicts(docs).groupBy(F.col("doc_id").alias("_doc_id")).agg(
        F.count("*").alias("n_lines"), F.count_if("kept").alias("n_kept"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("kept"), F.col("line_no")))).cast("array<string>"), ",").alias("numbers"),
    )
    return docs.select("doc_id").join(out, F.col("doc_id").eqNullSafe(F.col("_doc_id")), "left").select(
        "doc_id", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.coalesce("n_kept", F.lit(0)).cast("long").alias("n_kept"), F.sha2(F.coalesce("numbers", F.lit("")), 256).alias("kept_sha256")
    )


OP9_SQL = f"""
WITH l AS (SELECT doc_id, unnest(generate_series(0, len(a) - 1)) AS line_no, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL)),
n AS (SELECT doc_id, line_no, trim(regexp_replace(translate(line, '{UPPER}', '{LOWER_AZ}'), '\\s+', ' ', 'g')) AS norm FROM l),
c AS (SELECT norm, doc_id, line_no, row_number() OVER (ORDER BY doc_id, line_no) AS id
  FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id, line_no) AS rn FROM n WHERE norm <> '') WHERE rn = 1),
w AS (SELECT DISTINCT id, unnest(string_split(norm, ' ')) AS word FROM c),
r AS (SELECT id, word, row_number() OVER (PARTITION BY id ORDER BY df, word) AS pos, count(*) OVER (PARTITION BY id) AS n FROM w JOIN (SELECT word, count(*) AS df FROM w GROUP BY word) USING (word)),
p AS (SELECT * FROM r WHERE pos <= n - (80 * n + 99) // 100 + 1),
pairs AS (SELECT DISTINCT a.id AS a, b.id AS b, a.n AS na, b.n AS nb FROM p a JOIN p b ON a.word = b.word AND b.id < a.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
late AS (SELECT DISTINCT a FROM (SELECT a, b, na, nb, count(*) AS common FROM pairs JOIN w x ON x.id = a JOIN w y ON y.id = b AND y.word = x.word GROUP BY a, b, na, nb) WHERE common * 180 >= (na + nb) * 80),
k AS (SELECT n.doc_id, n.line_no, n.norm = '' OR (c.doc_id = n.doc_id AND c.line_no = n.line_no AND c.id NOT IN (SELECT a FROM late)) AS kept FROM n LEFT JOIN c ON c.norm = n.norm),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (kept) AS n_kept, string_agg(line_no::VARCHAR, ',' ORDER BY line_no) FILTER (kept) AS numbers FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_kept, 0) AS n_kept, sha256(coalesce(numbers, '')) AS kept_sha256 FROM documents d LEFT JOIN g USING (doc_id)
"""

QUERIES = {"op9_line_dedup": op9_line_dedup}
ORACLES = {"op9_line_dedup": OP9_SQL}
