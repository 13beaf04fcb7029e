"""Fuzzy line dedup: MinHash, banding, exact Jaccard, union-find, in DataFrame functions alone.

The hashed shingles of a line are an array that lives within its row: it is sorted once, and
all minima are read from it. Between steps the lines to compare are texts, an eighth of the
bytes of their hashed shingles.
"""

from __future__ import annotations

import contextlib
import functools
import itertools
import operator
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm.common import BROADCAST_BYTES, fresh, id_and_text, small
from quarrylens.llm.components import components
from quarrylens.session import materialize, quoted, scratch_folder

#: Characters of a shingle, one from every place of a line; a shorter line is one shingle.
SHINGLE = 10
#: Bytes of a character in UTF-32, where every place of a line is found at once.
WIDE = 4
#: Lets Spark remove the shuffle files of an action when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Shuffle files go when their action has ended: what is still needed is written. Java compiles no method of over 8,000
#: bytes; stages whose generated code has larger ones run as smaller pieces.
SETTINGS = {CLEANUP: "true", "spark.sql.codegen.hugeMethodLimit": "8000"}
#: Bands of a sample of shingles, and of all.
BANDS, ROWS = {"s": 14, "p": 10}, 3
PERCENT = 80
#: Where a band starts on the circle of hash values: its minima are the ROWS next values there.
PIVOTS = {k: [-(1 << 63) + i * ((1 << 64) // n) for i in range(n)] for k, n in BANDS.items()}
#: The shingles behind a space, overlapping ones too. A line that has SAMPLED distinct ones is signed by them,
#: one that has fewer than twice as many by those from all places.
BEHIND_SPACE = rf"(?s) (?=(.{{{SHINGLE}}}))"
SAMPLED = 16
KEYS = {k: [f"{k}{i}" for i in range(n)] for k, n in BANDS.items()}
#: Longs of a sketch: 64 bits each, of which a shingle turns one.
LONGS = 16
#: Lines that one side of a comparison of unsettled lines holds, about.
PART = 1024
#: Times that components are joined by their likeliest pairs before all others are verified.
ROUNDS = 3
#: Members of a bucket that are compared with their pivot in several tasks, and in how many.
HOT, SALTS = 4096, 16


class Scratch:
    """Tables that are removed together once nothing reads them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{scratch_folder(spark)}/{uuid.uuid4().hex}", 0

    def store(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.folder}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{self.n}")

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def settings(spark: SparkSession) -> Iterator[None]:
    """Every action inside runs with SETTINGS."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Signer:
    """Names of lines as Spark gives them, for use outside of it."""

    def __init__(self, second_seed: int):
        self.second_seed = second_seed  # of the second half of a line's name

    def names(self, lines: list[str]) -> tuple[np.ndarray, ...]:
        """Spark's xxhash64(line) and xxhash64(1, line) of every line."""
        from xxhash import xxh64_intdigest

        data = [line.encode("utf-8", "surrogatepass") for line in lines]
        return tuple(np.array([xxh64_intdigest(d, seed) for d in data], np.uint64).view(np.int64) for seed in (42, self.second_seed))


def grams(line: str) -> Column:
    """The hashed shingles of a line from all its places; null if it has fewer than SHINGLE characters."""

    def of(wide: Column) -> Column:
        places = F.sequence(F.lit(1), F.octet_length(wide) - (SHINGLE * WIDE - 1), F.lit(WIDE))
        hashed = F.transform(places, lambda at: F.xxhash64(F.substr(wide, at, F.lit(SHINGLE * WIDE))))
        return F.when(F.octet_length(wide) >= SHINGLE * WIDE, hashed)

    return F.transform(F.array(F.encode(line, "UTF-32")), of)[0]  # encoded once, not once a place


def signed(lines: DataFrame) -> DataFrame:
    """``lines`` with band keys of the minima of their shingles: s0.. from those behind a space, p0.. from all places.

    A long line has enough shingles behind spaces to be signed by them alone: they are a
    sample by content, so alike lines have alike samples. A short line, or one with few
    spaces, is signed by all places; lines in between by both, so that alike ones meet.
    The sorted hashes of a line are read as a circle. A minimum is the value next to a fixed
    one, the pivot, so every value of the line is it with the same chance. A band takes the
    ROWS distinct values after its pivot, round the circle as often as it needs.
    """
    found = F.regexp_extract_all("line", F.lit(BEHIND_SPACE), F.lit(1))
    lines = lines.withColumn("s", F.array_distinct(F.transform(found, lambda x: F.xxhash64(x))))
    few = F.size("s") < 2 * SAMPLED
    lines = lines.withColumn("p", F.when(few, F.array_distinct(grams("line")))).drop("line")
    lines = lines.withColumn("s", F.when(F.size("s") >= SAMPLED, F.col("s")))
    circles = {f"{k}_circle": F.sort_array(F.concat(k, F.array(*[F.lit(p) for p in PIVOTS[k]]))) for k in BANDS}
    lines = lines.withColumns({k: F.sort_array(k) for k in BANDS} | circles)

    # a place in the circle with pivots is less by those up to its own
    places = {k: [F.array_position(f"{k}_circle", F.lit(p)).cast("int") - 1 - i for i, p in enumerate(PIVOTS[k])] for k in BANDS}
    lines = lines.withColumns({f"{k}_at": F.array(*places[k]) for k in BANDS})

    def band(k: str, i: int) -> Column:
        at = F.get(f"{k}_at", F.lit(i))
        values = [F.get(k, (at + r) % F.size(k)) for r in range(ROWS)]
        return F.when(F.size(k) > 0, F.xxhash64(F.lit(i), *values)).alias(KEYS[k][i])

    return lines.select("doc_id", "h1", "h2", *[band(k, i) for k in BANDS for i in range(BANDS[k])])


def lines_of(rows: DataFrame) -> DataFrame:
    """doc_id, line_no, line and its 128-bit name (h1, h2), for every line with a word."""
    lines = rows.where("doc_id IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.where(F.col("line").rlike("\\S")).select(
        "doc_id", "line_no", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")
    )


def signed_lines(rows: DataFrame) -> DataFrame:
    """Distinct lines: name, copies, smallest document and band keys."""
    values = [F.max(c).alias(c) for c in itertools.chain(*KEYS.values())]  # equal lines have equal ones
    return signed(lines_of(rows)).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"), *values)


def texts_of(rows: DataFrame, needed: DataFrame) -> DataFrame:
    """(id, line) of the needed lines, from their first documents; ``needed`` has h1 and first_doc."""
    lines = rows.where("doc_id IS NOT NULL").select("doc_id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line"))
    lines = lines.select("doc_id", "line", F.xxhash64("line").alias("h1"))
    chosen = lines.join(small(needed.withColumnRenamed("first_doc", "doc_id"), 16), ["h1", "doc_id"], "left_semi")
    return chosen.select(F.col("h1").alias("id"), "line").distinct()  # rows that share an id may share lines


def verified(pairs: DataFrame, texts: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose lines are alike on all their shingles."""
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work
    found = pairs.repartition(tasks).join(texts.toDF("a", "line_a"), "a").join(texts.toDF("b", "line_b"), "b")
    found = found.select("a", "b", F.array_distinct(grams("line_a")).alias("x"), F.array_distinct(grams("line_b")).alias("y"))
    found = found.select("a", "b", (F.size("x") + F.size("y")).cast("bigint").alias("total"), F.size(F.array_intersect("x", "y")).alias("shared"))
    # written before it is filtered, so that sets are not made again for the condition
    found = scratch.store(found.select("a", "b", (100 * F.col("shared") >= percent * (F.col("total") - F.col("shared"))).alias("alike")))
    return found.where("alike").select("a", "b")


def sketches(texts: DataFrame) -> DataFrame:
    """Each line's number of distinct shingles and a sketch of them, LONGS longs t0..; a shingle turns one bit.

    Bits in which two sketches differ are at most as many as the shingles of one line alone.
    """
    shingles = texts.select("id", F.explode(F.array_distinct(grams("line"))).alias("h"))
    bit = F.expr("shiftleft(1L, CAST(shiftrightunsigned(h, 8) & 63 AS INT))")
    turned = [F.bit_xor(F.when(F.col("h").bitwiseAND(F.lit(LONGS - 1)) == i, bit).otherwise(F.lit(0))).alias(f"t{i}") for i in range(LONGS)]
    return shingles.groupBy("id").agg(F.count(F.lit(1)).alias("shingles"), *turned)


def unsettled_links(members: DataFrame, labels: DataFrame, links: DataFrame, texts: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """``links`` and those between components in the buckets that still hold several.

    The lines of these buckets are dealt into parts of about PART lines by their largest
    bucket. Every two parts that meet in a bucket are one tile, in which lines of different
    components are paired unless their sketches rule it out for certain. In some rounds each
    component has its likeliest pair verified, which joins most; then all pairs are whose
    components are still apart.
    """
    labelled = (
        members.where("members > 2")  # a bucket of two is settled by its one pair
        .join(labels, "id", "left").select("band", "id", "members", F.coalesce("component", "id").alias("label"))
    )
    mixed = labelled.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("band")
    unsettled = scratch.store(labelled.join(mixed, "band", "left_semi"))
    home = unsettled.groupBy("id", "label").agg(F.max(F.struct("members", "band")).alias("h")).select("id", "label", F.col("h.band").alias("home"))
    home = scratch.store(home)
    parts = home.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"))
    low = [f"t{i}" for i in range(LONGS)]
    part = F.xxhash64("home", F.pmod(F.xxhash64("id"), "parts")).alias("part")
    # few bytes, much work: lines are dealt over all tasks
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sketched = scratch.store(sketches(texts.join(home.select("id"), "id", "left_semi").repartition(tasks)))
    placed = home.join(parts, "home").join(sketched, "id")
    placed = scratch.store(placed.select("id", "label", *low, "shingles", part))
    meeting = unsettled.join(placed.select("id", "part"), "id").select("band", "part").distinct()
    held = placed.groupBy("part").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    meeting = meeting.join(held, "part")
    other = meeting.toDF("other", "band", "lo2", "hi2")
    # two parts of one and the same component have nothing to compare
    tiles = meeting.join(other, "band").where("part <= other AND NOT (lo = hi AND lo2 = hi2 AND lo = lo2)")
    tiles = scratch.store(tiles.select(F.col("part").alias("i"), F.col("other").alias("j")).distinct())
    # few bytes, many pairs: tiles are dealt over all tasks, which a repartition by number keeps
    x, y = (
        tiles.join(placed.toDF(f"id_{end}", f"label_{end}", *(f"{c}_{end}" for c in low), f"shingles_{end}", "part"), F.col(end) == F.col("part"))
        .drop("part").repartition(tasks, "i", "j")
        for end in ("i", "j")
    )
    total = F.col("shingles_i") + F.col("shingles_j")
    differing = functools.reduce(operator.add, [F.bit_count(F.col(f"{c}_i").bitwiseXOR(F.col(f"{c}_j"))) for c in low])
    near = 100 * (total - differing) >= percent * (total + differing)
    fits = 100 * F.least("shingles_i", "shingles_j") >= percent * F.greatest("shingles_i", "shingles_j")
    once = (F.col("i") < F.col("j")) | (F.col("id_i") < F.col("id_j"))
    met = x.join(y, ["i", "j"]).where(once & (F.col("label_i") != F.col("label_j")) & fits & near)
    a, b = F.least("id_i", "id_j").alias("a"), F.greatest("id_i", "id_j").alias("b")
    first, second = F.least("label_i", "label_j").alias("first"), F.greatest("label_i", "label_j").alias("second")
    pairs = scratch.store(met.select(a, b, first, second, (differing / total).alias("differing")).distinct())
    found = links
    for _ in range(ROUNDS):
        if pairs.isEmpty():
            break
        ends = pairs.select(F.explode(F.array("first", "second")).alias("label"), F.struct("differing", "a", "b").alias("p"))
        likeliest = scratch.store(ends.groupBy("label").agg(F.min("p").alias("p")).select("p.a", "p.b").distinct())
        found = found.unionByName(verified(likeliest, texts, percent, scratch))
        now = scratch.store(components(found))
        rest = pairs.select("a", "b", "differing").join(likeliest, ["a", "b"], "left_anti")
        rest = rest.join(now.toDF("a", "of_a"), "a", "left").join(now.toDF("b", "of_b"), "b", "left")
        rest = rest.select("a", "b", F.coalesce("of_a", "a").alias("first"), F.coalesce("of_b", "b").alias("second"), "differing")
        pairs = scratch.store(rest.where(F.col("first") != F.col("second")))
    return found if pairs.isEmpty() else found.unionByName(verified(pairs.select("a", "b"), texts, percent, scratch))


def linked(classes: DataFrame, rows: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(id, component) of every line that is linked to another one.

    The buckets of a band do not emit their pairs. First each member is compared with the
    member that shares most buckets with others. Only buckets that still hold several
    components after that compare members across components.
    """
    sampled, plain = (F.array(*KEYS[k]) for k in BANDS)
    held = F.when(F.col(KEYS["p"][0]).isNull(), sampled).when(F.col(KEYS["s"][0]).isNull(), plain).otherwise(F.concat(sampled, plain))
    keys = classes.where(F.coalesce(KEYS["s"][0], KEYS["p"][0]).isNotNull()).select(F.col("h1").alias("id"), F.explode(held).alias("band"))
    shared = scratch.store(keys.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    members = scratch.store(keys.join(small(shared, 16), "band"))
    popular = members.groupBy("id").agg(F.sum("members").alias("popularity"))
    needed = scratch.store(classes.select("h1", "first_doc").join(popular.select(F.col("id").alias("h1")), "h1", "left_semi"))
    texts = scratch.store(texts_of(rows, needed))

    def stars(points: DataFrame, pivots: DataFrame) -> DataFrame:
        """Links of each member with the pivot of its bucket; a hot bucket is spread by salt."""
        salts = F.when(F.col("members") > HOT, SALTS).otherwise(1)
        spread = pivots.select("band", "pivot", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
        met = points.withColumn("salt", F.pmod(F.xxhash64("id"), salts).cast("int")).join(spread, ["band", "salt"])
        pairs = met.where("id <> pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
        return verified(scratch.store(pairs), texts, percent, scratch)

    middle = members.join(popular, "id").groupBy("band", "members").agg(F.max(F.struct("popularity", "id")).alias("top"))
    links = stars(members, middle.select("band", "members", F.col("top.id").alias("pivot")))
    labels = scratch.store(components(links))
    return scratch.store(components(unsettled_links(members, labels, links, texts, percent, scratch)))


def dropped_lines(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id and the numbers of the lines to drop: all of a component but its first place."""
    scratch = Scratch(rows.sparkSession)
    classes = scratch.store(signed_lines(rows))
    labels = linked(classes, rows, percent, scratch)
    named = classes.join(labels.withColumnRenamed("id", "h1"), "h1", "left").where("copies > 1 OR component IS NOT NULL")
    named = scratch.store(named.select("h1", "h2", "first_doc", F.coalesce("component", "h1").alias("component")))
    home = named.groupBy("component").agg(F.min("first_doc").alias("home"))
    named = scratch.store(named.join(home, "component").select("h1", "h2", "component", "home"))
    places = scratch.store(
        lines_of(rows).select("doc_id", "line_no", "h1", "h2").join(small(named, 32), ["h1", "h2"]).select("doc_id", "line_no", "component", "home")
    )
    first = places.where("doc_id = home").groupBy("component").agg(F.min("line_no").alias("first"))
    out = places.join(first, "component").where("doc_id <> home OR line_no <> first")
    out = materialize(out.groupBy("doc_id").agg(F.collect_set("line_no").alias("dropped")))
    scratch.drop()
    return out


def dedup_lines(
    docs: DataFrame,
    percent: int = PERCENT,
    id_column: str = "doc_id",
    text_column: str = "text",
    lines_column: str = "lines",
    dropped_column: str = "dropped_lines",
) -> DataFrame:
    """``docs`` with the texts less their duplicate lines, and two counts: lines and dropped lines.

    Lines lie between line feeds; those without a word stay and are not counted. The
    shingles of a line are the SHINGLE characters from every place in it. Lines are linked
    if they are equal, or if the Jaccard similarity of their distinct shingles is
    ``percent`` or more; of each connected component the first line (smallest id, then
    smallest place) stays. Candidates come from bands of ROWS minima, and every link is
    verified exactly, on all shingles. Minima are those of all shingles in a line with fewer
    than 2 * SAMPLED distinct ones behind spaces, in 10 bands: a pair at the threshold misses
    all with a probability of 7.7e-4. In a line with SAMPLED or more, they are of those behind
    spaces, in 14 bands: 4.3e-5 where these are as alike as all are, 2.8e-3 where they are alike
    by 0.7. Above the threshold all fall fast. What sketches rule out of a bucket of more than
    two is certain. Lines go by 64 bits of their hash between those steps: among 1e12 distinct
    lines some thousand unrelated pairs share it.

    Line texts are not shuffled for candidates: what is shuffled is one signature per line,
    folded by line in the task. A line copied any number of times is one row after that.

    A null text stays null and has no lines; a row with a null id is left as it is. Rows
    that share an id are one document. Very long texts and lines are read whole; an empty
    table stays empty. Columns of ``docs`` with the names of the counts are replaced.
    """
    with settings(docs.sparkSession):
        drops = dropped_lines(id_and_text(docs, id_column, text_column), percent)
        held = drops.agg(F.sum(32 + 8 * F.size("dropped"))).first()[0] or 0
    key, gone, parts = fresh(docs, "key"), fresh(docs, "gone"), fresh(docs, "parts")
    drops = drops.withColumnsRenamed({"doc_id": key, "dropped": gone})
    drops = F.broadcast(drops) if held <= BROADCAST_BYTES else drops
    text = quoted(text_column)
    joined = docs.join(drops, quoted(id_column).cast("bigint") == F.col(key), "left").withColumn(parts, F.split(text, "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone)
    rebuilt = F.when(F.col(gone).isNull(), text).otherwise(F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n"))
    counted = F.size(F.filter(parts, lambda line: line.rlike("\\S")))
    return joined.withColumns(
        {
            lines_column: F.when(text.isNull(), F.lit(0)).otherwise(counted).cast("bigint"),
            dropped_column: F.when(F.col(gone).isNull(), F.lit(0)).otherwise(F.size(gone)).cast("bigint"),
            text_column: rebuilt,
        }
    ).drop(key, gone, parts)
