"""Table verbs over pieces and the tables around them: joins, set operations, reshaping, ranking, sampling, text helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that paths are searched for, in this order, and the composers they stand for.
COMPOSERS = (
    (("bach",), "Bach"), (("mozart", "mz_"), "Mozart"), (("chopin", "chpn"), "Chopin"), (("deb",), "Debussy"),
    (("beethoven", "mond_", "appass"), "Beethoven"), (("liszt", "liz_"), "Liszt"),
    (("schubert", "schu"), "Schubert"), (("brahms", "br_"), "Brahms"), (("haydn", "hay_"), "Haydn"), (("schumann", "scn"), "Schumann"),
)
#: Eras of composers, by short and by full name.
ERAS = {
    "Bach": "Baroque", "Mozart": "Classical", "Haydn": "Classical", "Beethoven": "Classical", "Chopin": "Romantic", "Schubert": "Romantic",
    "Brahms": "Romantic", "Schumann": "Romantic", "Liszt": "Romantic", "Debussy": "Late Romantic",
    "Johann Sebastian Bach": "Baroque", "Antonio Vivaldi": "Baroque", "George Frideric Handel": "Baroque", "Wolfgang Amadeus Mozart": "Classical",
    "Joseph Haydn": "Classical", "Ludwig van Beethoven": "Classical",
    "Franz Schubert": "Romantic", "Frédéric Chopin": "Romantic", "Robert Schumann": "Romantic", "Johannes Brahms": "Romantic",
    "Pyotr Ilyich Tchaikovsky": "Romantic", "Franz Liszt": "Romantic",
    "Claude Debussy": "Late Romantic", "Sergei Rachmaninoff": "Late Romantic", "Maurice Ravel": "Late Romantic",
}


def keep_last(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Union of two tables with one row per key: the newer table's, and in it the one that comes last in order."""
    rows = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    best = Window.partitionBy(key).orderBy(F.desc("_age"), F.desc(order))
    return rows.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k", "_age")


def near_in_time(events: DataFrame, seconds: float, by: str = "user_id") -> DataFrame:
    """(by, a, b): pairs of a key's events that are less than ``seconds`` apart, a before b. Events meet in time buckets and their neighbours,
    so the join is on equality; in a burst of n events of one key within the time, all n * (n - 1) / 2 pairs are the result.
    """
    t = F.col("ts").cast("timestamp").cast("double")
    rows = events.select(F.col(by), F.col("event_id"), t.alias("t"), F.floor(t / seconds).cast("long").alias("bucket"))
    other = rows.select(
        F.col(by), F.col("event_id").alias("b"), F.col("t").alias("tb"), F.explode(F.array(F.col("bucket"), F.col("bucket") - 1)).alias("bucket")
    )
    met = rows.select(F.col(by), F.col("event_id").alias("a"), F.col("t").alias("ta"), "bucket").join(other, [by, "bucket"])
    later = (F.col("tb") > F.col("ta")) | ((F.col("tb") == F.col("ta")) & (F.col("b") > F.col("a")))
    return met.where(later & (F.col("tb") - F.col("ta") < seconds)).select(by, "a", "b")


def tail(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The last n rows in a stated order."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def every(df: DataFrame, step: int, column: str = "seq") -> DataFrame:
    """Stride sample."""
    return df.where(F.col(column) % step == 0)


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) of values in [low, high]; the last bin is closed."""
    x = F.col(column)
    at = F.when(x == high, bins - 1).otherwise(F.floor((x - low) / ((high - low) / bins))).cast("int")
    return df.where((x >= low) & (x <= high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def sections(notes: DataFrame, gap: int = 12) -> DataFrame:
    """(piece_id, section, first_seq, notes): stretches between jumps of more than ``gap`` semitones."""
    order = Window.partitionBy("piece_id").orderBy("seq")
    jump = F.when(F.abs(F.col("pitch") - F.lag("pitch").over(order)) > gap, 1).otherwise(0)
    marked = notes.withColumn("_j", jump).withColumn("section", F.sum("_j").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("piece_id", "section").agg(F.min("seq").alias("first_seq"), F.count("*").alias("notes"))


def links(pages: DataFrame, suffix: str = "", most: int | None = None) -> DataFrame:
    """(page_id, position, link): targets of anchors that end in a suffix, in order, at most ``most`` a page."""
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    rows = pages.select("page_id", F.posexplode(F.filter(found, lambda x: x.endswith(suffix))).alias("position", "link"))
    return rows if most is None else rows.where(F.col("position") < most)


def composer_of(path: Column) -> Column:
    """The first known name that a path holds, in any case; else Unknown."""
    out = F.lit("Unknown")
    for words, name in reversed(COMPOSERS):
        out = F.when(F.lower(path).rlike("|".join(words)), name).otherwise(out)
    return out


def era_of(composer: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in ERAS.items() for x in pair])[F.trim(composer)], F.lit("Other"))


def slug(text: Column) -> Column:
    """Lower case, without punctuation, words joined by single dashes."""
    plain = F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9\s_-]", "")
    return F.regexp_replace(F.regexp_replace(plain, r"[\s_-]+", "-"), "^-+|-+$", "")


def track_id(path: Column, name: Column) -> Column:
    return F.concat(slug(name), F.lit("-"), F.substring(F.md5(path), 1, 8))


def band(value: Column, low: float = 0.3, high: float = 0.6, names: tuple[str, str, str] = ("low", "moderate", "high")) -> Column:
    return F.when(value < low, names[0]).when(value < high, names[1]).otherwise(names[2])


def squash(value: Column) -> Column:
    """A z-score mapped to 0..1."""
    return 1 / (1 + F.pow(F.lit(2.718), value * -0.6))


def quality_flags(notes: DataFrame, least_notes: int = 50, most_duration: float = 1200.0) -> DataFrame:
    """(piece_id, notes, total, quality_flag, quality_note): pieces with too few notes or too long are flagged 0 with the reason."""
    per = notes.groupBy("piece_id").agg(F.count("*").alias("notes"), F.max(F.col("start") + F.col("duration")).alias("total"))
    note = F.when(F.col("notes") < least_notes, "too_few_notes").when(F.col("total") > most_duration, "too_long").otherwise("")
    return per.withColumn("quality_note", note).withColumn("quality_flag", F.when(F.col("quality_note") == "", 1).otherwise(0))


def pitch_time_grid(notes: DataFrame, columns: int = 50, lowest: int = 21, keys: int = 88) -> DataFrame:
    """(piece_id, key, column, n): how many notes sound in each cell of a grid over keys and time."""
    w = Window.partitionBy("piece_id")
    total = F.max(F.col("start") + F.col("duration")).over(w)
    at = lambda t: F.least(F.floor(t / F.col("total") * columns), F.lit(columns - 1)).cast("int")
    rows = notes.withColumn("total", total).where(F.col("pitch").between(lowest, lowest + keys - 1))
    cells = rows.select(
        "piece_id", (F.col("pitch") - lowest).alias("key"),
        F.explode(F.sequence(at(F.col("start")), at(F.col("start") + F.col("duration")))).alias("column")
    )
    return cells.groupBy("piece_id", "key", "column").agg(F.count("*").alias("n"))
