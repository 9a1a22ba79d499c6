"""URL filters: rules first, then logistic regression on hashed character n-grams of host and path.

Defined results: a null url, or one without "://", has an empty host and path, fits no rule and is scored as an empty text; repeated rows get
the same verdict each; an empty table gives an empty result; columns other than the ones named are ignored. The model is fitted on the
driver from a labelled table of at most ``most_rows`` rows (a parameter; more is an error), and scoring reads every row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import map_batches, prefix_hash, slices, span_hash, table

#: Rules of the contract: (host, beginning of the path, verdict).
RULES = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of the labelled table at most.
MOST_LABELLED = 20_000
GRAMS, BITS = (4, 5, 6), 18
#: How many times likelier an unknown host is taken to be unwanted than one of the labelled table: real ones hold fewer of the words.
ODDS = 1.4


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_column(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls. A rule fits its host and subdomains where the path starts with its own."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _grams(texts: pa.Array, part: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the character n-grams, each text between marks; part keeps those of hosts and paths apart."""
    rows, features = [], []
    for i, _, data, offsets in slices(texts):
        lengths = np.diff(offsets)
        marked = np.full(len(data) + 2 * len(lengths), 0x5E, np.uint8)
        begins = offsets[:-1] + 2 * np.arange(len(lengths))
        inner = np.ones(len(marked), bool)
        inner[begins], inner[begins + lengths + 1] = False, False
        marked[inner] = data
        starts = np.flatnonzero((marked & 0xC0) != 0x80)  # of characters
        of = np.searchsorted(begins, starts, "right") - 1
        stops = np.append(starts, len(marked))
        prefix = prefix_hash(marked)
        for n in GRAMS:
            at = np.arange(max(0, len(starts) - n + 1))
            at = at[of[at] == of[at + n - 1]]
            rows.append(i + of[at])
            features.append((span_hash(prefix, stops[at], stops[at + n]) + np.uint64(part)) >> np.uint64(64 - BITS))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(features).astype(np.int64)


def _features(hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of hosts and paths. A part's n-grams weigh one over the root of their number, so that a long path does not
    outweigh its host.
    """
    found = []
    for part, texts in enumerate((hosts, paths)):
        rows, features = _grams(texts, part << 60)
        found.append((rows, features, (1 / np.sqrt(np.maximum(np.bincount(rows, minlength=len(texts)), 1)))[rows]))
    return tuple(np.concatenate(x) for x in zip(*found))


@dataclass(frozen=True)
class Model:
    """Weights by feature."""

    weights: np.ndarray
    bias: float

    def probability(self, hosts: pa.Array, paths: pa.Array) -> np.ndarray:
        rows, features, values = _features(hosts, paths)
        z = np.bincount(rows, self.weights[features] * values, len(hosts))
        return 1 / (1 + np.exp(-(z + self.bias)))


def fit(hosts: Sequence[str], paths: Sequence[str], blocked: Sequence[int], rounds: int = 300, rate: float = 0.5, l2: float = 1e-5) -> Model:
    """Logistic regression by full-batch adaptive gradients; the same rows in the same order give the same model."""
    y, n = np.asarray(blocked, float), len(blocked)
    rows, features, values = _features(*(pa.array(list(texts), pa.string()) for texts in (hosts, paths)))
    used, features = np.unique(features, return_inverse=True)
    weights, bias, seen, seen_bias = np.zeros(len(used)), 0.0, np.full(len(used), 1e-8), 1e-8
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(np.bincount(rows, weights[features] * values, n) + bias)))
        error = (p - y) / max(n, 1)
        slope = np.bincount(features, error[rows] * values, len(used)) + l2 * weights
        seen += slope**2
        weights -= rate * slope / np.sqrt(seen)
        seen_bias += error.sum() ** 2
        bias -= rate * error.sum() / np.sqrt(seen_bias)
    every = np.zeros(1 << BITS, np.float32)
    every[used] = weights
    return Model(every, float(bias))


def fit_table(labelled: DataFrame, url_col: str = "url", label_col: str = "blocked", most_rows: int = MOST_LABELLED) -> Model:
    """Fits on a labelled table (url, 0 or 1) of at most ``most_rows`` rows; a larger one is refused rather than cut."""
    host, path = host_and_path(F.col(url_col))
    rows = labelled.where(F.col(label_col).isNotNull()).select(
        host.alias("h"), path.alias("p"), F.col(label_col).cast("int").alias("y")
    ).orderBy("h", "p", "y").limit(most_rows + 1).toArrow()
    if rows.num_rows > most_rows:
        raise ValueError(f"the labelled table has more than {most_rows} rows")
    return fit(rows["h"].to_pylist(), rows["p"].to_pylist(), rows["y"].to_pylist())


#: Words of hosts that filters block, by subject: gambling, adult, pills, advertising and tracking, spam and fraud, pirated goods.
UNWANTED = (
    "casino", "poker", "jackpot", "bets", "betting", "sportsbet", "slots", "roulette", "bingo", "lottery", "blackjack", "baccarat", "gambling", "wager",
    "adult", "porn", "porno", "xxx", "sex", "sexy", "sexcam", "nude", "escort", "escorts", "cams", "camgirls", "erotic", "hentai", "milf", "fetish",
    "onlyfans", "xvideos", "redtube", "tube8", "nsfw", "hookup", "strip",
    "pills", "viagra", "cialis", "sildenafil", "tadalafil", "xanax", "tramadol", "meds", "steroid", "steroids", "rxmeds", "pharmacyrx", "weightloss",
    "ads", "adserver", "adservice", "adtrack", "adnetwork", "doubleclick", "syndication", "googlesyndication", "taboola", "outbrain", "banner", "track",
    "tracker", "tracking", "popup", "popads", "clicks", "clicktrack", "pixel", "retarget", "affiliates",
    "spam", "phish", "phishing", "malware", "scam", "payday", "paydayloan", "loans", "cashadvance", "cash-advance", "clickbait", "getrich", "verify-account",
    "login-secure", "free-iphone", "giveaway", "cryptodoubler",
    "warez", "torrent", "torrents", "piratebay", "1337x", "keygen", "cracked", "serialkeys", "nulled", "replica", "replicas", "fakes", "fakewatches",
)
#: Words of hosts that they leave alone; those of the last lines hold what unwanted words are made of.
WANTED = (
    "news", "science", "library", "university", "research", "museum", "docs", "wiki", "history", "health", "weather", "school",
    "garden", "recipes", "music", "travel", "journal", "archive", "forum", "city", "sport", "open", "story", "books", "maps",
    "kitchen", "camera", "bicycle", "hospital", "railway", "theatre", "village", "market", "harbour", "mountain", "college",
    "engineer", "painting", "teacher", "student", "language", "software", "data", "cloud", "code", "paper", "radio", "nature",
    "family", "animal", "winter", "church", "street", "island", "coffee", "trade", "bank", "house", "energy", "water",
    "times", "post", "daily", "guide", "review", "support", "blog", "digital", "global", "group", "law",
    "essex", "sussex", "middlesex", "wessex", "sextant", "sexton", "stackoverflow", "overflow", "trackandfield", "racetrack", "soundtrack", "tracks",
    "railtrack", "scaffold", "scaffolding", "fakenham", "slotcar", "slotcars", "timeslot", "parking", "roads", "beads", "leads", "loads", "downloads",
    "uploads", "threads", "heads", "broadband", "broads", "pads", "grads", "camshaft", "camstudy", "campus", "cambridge", "webcampus", "scampi",
    "alphabet", "tibet", "diabetes", "better", "elizabeth", "medscape", "medschool", "medstudents", "comedy", "remedies",
    "adulteducation", "adultlearning", "pixelart", "pixels", "megapixel", "bannerman", "spamassassin", "crackers", "nutcracker", "firecracker",
    "steroidscience", "asteroid", "asteroids", "torrential", "torrance", "porn-recovery", "pokeberry", "popular", "population", "stripe", "striped",
    "clickhouse", "clicker", "scamper", "lottie", "loanword", "cashmere", "advance", "affiliated", "trackpad", "netadmin", "adsorption", "adscience",
    "replication", "milford", "wagering-law", "escortwagon", "analysis", "middlesexcounty", "sexed", "expertsexchange",
)
#: Words that go with either.
BESIDE = (
    "free", "online", "best", "now", "win", "cheap", "hot", "live", "club", "world", "my", "the", "deal", "buy", "top", "farm", "x", "pro", "24",
    "hub"
)
_TOPS = ("com", "net", "org", "info", "biz", "io", "co.uk", "de")
_SUBDOMAINS = ("", "", "www.", "m.", "blog.", "shop.")
_SYLLABLES = (
    "an", "er", "on", "th", "in", "re", "st", "sh", "ou", "le", "ti", "en", "ba", "ko", "mi", "ra", "sel", "tor", "ven", "lu", "du", "gar", "pel",
    "wick", "ham", "bur"
)


def labelled_urls(hosts: int = 1200, seed: int = 11) -> list[tuple[str, int]]:
    """The small labelled table (url, 1 for blocked): ``hosts`` hosts of each label with two urls each, made by rule from the word lists.

    A host is a word or two of its label, a word that goes with either, and digits, joined or hyphenated; half of the clean hosts are names
    of a few syllables. Paths are of the kinds that occur with both, and a third have a word of the label in them.
    """
    rng = np.random.default_rng(seed)
    pick = lambda words: words[int(rng.integers(len(words)))]
    out, met = [], set()
    for label, words in ((0, WANTED), (1, UNWANTED)):
        n = 0
        while n < hosts:
            if label == 0 and rng.random() < 0.5:
                name = "".join(pick(_SYLLABLES) for _ in range(int(rng.integers(2, 6))))
            else:
                parts = [pick(words), pick(BESIDE if rng.random() < 0.6 else words)][: 1 if rng.random() < 0.2 else 2]
                name = ("-" if rng.random() < 0.5 else "").join(reversed(parts) if rng.random() < 0.5 else parts)
            name += str(int(rng.integers(1, 1000))) if rng.random() < 0.15 else ""
            host = f"{pick(_SUBDOMAINS)}{name}{'.' + pick(_SYLLABLES) + pick(_SYLLABLES) if rng.random() < 0.2 else ''}.{pick(_TOPS)}"
            if host in met:
                continue
            met.add(host)
            n += 1
            for _ in range(2):
                number = int(rng.integers(1, 100_000))
                slug = f"/{pick(words)}-{pick(BESIDE)}.html"
                path = pick(
                    ("", "/", "/index.php", f"/p/{number}", f"/{2000 + number % 25}/{1 + number % 12:02d}/post", f"/item/{number}.html", slug, slug, slug)
                )
                out.append((f"http{'s' if rng.random() < 0.5 else ''}://{host}{path}", label))
    return out


def split_url(url: str) -> tuple[str, str]:
    """host_and_path() of one url."""
    rest = url.partition("://")[2]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    return rest[:end].translate(str.maketrans(_UPPER, _LOWER)), rest[end:].partition("#")[0].partition("?")[0]


@cache
def default_model() -> Model:
    parts = [(*split_url(u), y) for u, y in labelled_urls()]
    model = fit(*zip(*parts))
    return Model(model.weights, model.bias + float(np.log(ODDS)))


def judge(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, model: Model | None = None,
    threshold: float = 0.5
) -> DataFrame:
    """(id, host, path, rule, verdict, probability): the longest fitting rule's verdict, else block where the model's probability passes the
    threshold.
    """
    model = model or default_model()
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_column(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "by_rule": verdict})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch(
                [*batch.columns, pa.array(model.probability(batch.column(1), batch.column(2)))], [*batch.schema.names, "probability"]
            )

    scored = map_batches(rows, run, _schema_with(rows, "probability double"))
    return scored.select(
        "id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("probability") >= threshold, "block").otherwise("allow")).alias("verdict"),
        "probability"
    )


def _schema_with(df: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), more])


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id").drop("probability")


QUERIES = {"op3_urls": op3_urls}
