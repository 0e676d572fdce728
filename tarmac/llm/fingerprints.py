"""Document fingerprints by consistent weighted sampling.

A text is a bag of words, each weighted by how often it occurs. For each of ``samples`` draws, every word gets gamma(2, 1) variates r and c and a uniform b, all from hashes of the word and the draw, hence the same in every text. With weight w, t = floor(ln w / r + b) and ln a = ln c - r (t - b) - r; the word of least a is drawn, and its (word, t) is the draw's code. Two texts have equal codes with a probability that is the generalised Jaccard similarity of their bags (sum of least weights over sum of greatest), so the share of equal codes estimates it.

All steps are DataFrame functions; one narrow table, a row for each block, is written to the shared folder. A draw's least is one minimum over 64-bit values: ln a in fixed point above, the code's hash below. Documents are placed once, in blocks of consecutive ids; the next document, the counts of words, the draws and the next fingerprint all build on that one exchange.

Defined cases: a null text counts as empty; texts without words have one fingerprint of their own, alike to each other; ids order documents, nulls first and rows that share an id by their texts; rows that repeat are each returned; the only row is its own next document; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarmac.llm.common import documents, one_before, range_block, written

#: Blocks whose first keys are broadcast at most; more are joined by a shuffle.
MOST_HEADS = 100_000
#: What stands for a text without words.
_NONE = (1 << 62) + 77


def draw(word: Column, log_weight: Column, k: int) -> Column:
    """ln a in fixed point (31 bits), then 32 bits of the hash of (word, t)."""
    first, second = F.xxhash64(word, F.lit(2 * k)), F.xxhash64(word, F.lit(2 * k + 1))
    unit = 2.0**-21
    part = lambda h, i: (F.shiftrightunsigned(h, 43 - 21 * i).bitwiseAND((1 << 21) - 1) + 0.5) * unit
    r = -F.log(part(first, 0) * part(first, 1))
    log_c = F.log(-F.log(part(first, 2) * part(second, 0)))
    b = part(second, 1)
    t = F.floor(log_weight / r + b)
    log_a = log_c - r * (t - b) - r
    place = (F.greatest(log_a + 128.0, F.lit(0.0)) * float(1 << 23)).cast("long")
    return F.shiftleft(place, 32).bitwiseOR(F.xxhash64(word, t, F.lit(k)).bitwiseAND((1 << 32) - 1))


def signatures(words: DataFrame, by: list[str], samples: int) -> DataFrame:
    """by, own, other (arrays of long): the sketches of two texts. ``words`` has rows (by, word, own, other): a word and how often it occurs in each; null for a text without words.

    Most words occur as often in both texts and are drawn once for both; the others are drawn for each.
    """
    counted = words.groupBy(*by, "word").agg(F.sum("own").alias("own"), F.sum("other").alias("other"))
    case = lambda n, mask: F.struct(F.col(n).alias("n"), F.lit(mask).alias("mask"))
    cases = F.when(F.col("own") == F.col("other"), F.array(case("own", 3))).when(F.col("other") == 0, F.array(case("own", 1))).when(F.col("own") == 0, F.array(case("other", 2)))
    rows = counted.select(*by, "word", F.explode(cases.otherwise(F.array(case("own", 1), case("other", 2)))).alias("c"))
    none, mask = (1 << 63) - 1, F.when(F.col("word").isNull(), F.lit(0)).otherwise(F.col("c.mask"))
    rows = rows.select(
        *by, F.coalesce("word", F.lit(0)).alias("word"), F.log(F.greatest(F.col("c.n"), F.lit(1)).cast("double")).alias("log_weight"),
        *[F.when(mask.bitwiseAND(bit) > 0, F.lit(0)).otherwise(F.lit(none)).cast("long").alias(f"not_{name}") for bit, name in ((1, "own"), (2, "other"))],
    )
    # no condition around a draw: so both of its minima share one evaluation
    least = lambda k, name: F.min(F.greatest(draw(F.col("word"), F.col("log_weight"), k), F.col(f"not_{name}"))).alias(f"{name}{k}")
    drawn = rows.groupBy(*by).agg(*[least(k, name) for k in range(samples) for name in ("own", "other")])
    code = lambda c: F.when(F.col(c) == none, F.lit(_NONE)).otherwise(F.col(c)).bitwiseAND((1 << 32) - 1)
    return drawn.select(*by, *[F.array(*[code(f"{name}{k}") for k in range(samples)]).alias(name) for name in ("own", "other")])


def likeness(a: Column, b: Column) -> Column:
    """The share of equal codes."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) / F.size(a)


def text_of(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def word_hashes(text: Column) -> Column:
    """Hashes of the words, which blanks (space and 9 to 13) part; [null] if there are none."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(hashes) > 0, hashes).otherwise(F.array(F.lit(None).cast("long")))


def neighbours(docs: DataFrame, key: str, text: str, block_bytes: int) -> DataFrame:
    """block, place (row number in the block), copy, key, body, after: the next document's text, the first's after the last. Rows with ``copy`` stand behind each block for the first document of the next one."""
    block, blocks = range_block(docs, key, text, block_bytes)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"), block.alias("block"))
    heads = written(rows.groupBy("block").agg(F.min(F.struct(F.col("key").isNotNull().alias("known"), "key")).alias("head")), "fingerprints-heads", narrow=True)
    # the first block's head stands behind the last
    heads = heads.join(one_before(heads.select("block"), "block"), F.col("block") == F.col("of")).select("of", "before", F.col("head.key").alias("head"))
    # a row for each block
    copies = rows.join(F.broadcast(heads) if blocks <= MOST_HEADS else heads, (F.col("block") == F.col("of")) & F.col("key").eqNullSafe(F.col("head")))
    copies = copies.groupBy("before").agg(F.min(F.struct("key", "body")).alias("first")).select(F.col("first.key").alias("key"), F.col("first.body").alias("body"), F.col("before").alias("block"))
    both = rows.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("copy", F.lit(True)))
    order = Window.partitionBy("block").orderBy("copy", "key", "body")
    return both.withColumn("place", F.row_number().over(order)).withColumn("after", F.lead("body").over(order))


def edited(body: Column, after: Column) -> Column:
    """The last quarter of the code points replaced by the first as many of ``after``."""
    n = F.length(body)
    quarter = F.floor(n / 4).cast("int")
    return F.concat(F.substring(body, F.lit(1), n - quarter), F.substring(after, F.lit(1), quarter))


def fingerprinted(docs: DataFrame, samples: int = 32, key: str = "doc_id", text: str = "text", block_bytes: int = 250_000) -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    near = neighbours(docs, key, text, block_bytes).withColumn("edited", edited(F.col("body"), F.coalesce("after", F.lit(""))))
    about = near.filter("NOT copy").select("block", "place", "key", F.length("body").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    text_words = lambda c, own: F.struct(word_hashes(F.col(c)).alias("words"), F.lit(own).alias("own"), F.lit(1 - own).alias("other"))
    words = near.select("block", "place", F.explode(F.array(text_words("body", 1), text_words("edited", 0))).alias("v"))
    words = words.select("block", "place", "v.own", "v.other", F.explode("v.words").alias("word"))
    drawn = signatures(words, ["block", "place"], samples)
    drawn = drawn.withColumn("next", F.lead("own").over(Window.partitionBy("block").orderBy("place")))
    drawn = drawn.select(
        F.col("block").alias("b"), F.col("place").alias("p"), text_of(F.col("own")).alias("fingerprint"), text_of(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
    return about.join(drawn, (F.col("block") == F.col("b")) & (F.col("place") == F.col("p"))).select(F.col("key").alias(key), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text; their likeness, and that to the next document's."""
    return fingerprinted(documents(spark, sf_dir))
