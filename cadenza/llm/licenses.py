"""License scans: a trained paragraph classifier over sparse word n-grams, with an unknown class and a template check. DataFrame functions only.

Paragraphs are what blank lines set apart. A paragraph is scored as a whole, so that notices wrapped over lines are found, and line by line,
so that a notice of one line amid prose is. Its families are those of its lines that hold a whole template; else that of the paragraph as a
whole; else those of its lines. A family counts only if its calibrated probability passes the threshold and the templates agree.

A text, paragraph or line in which none of the model's marks stands (telling_words) is unknown whatever else it holds, since its other words
cannot lift any family over the threshold; that is derived from the weights, and loses nothing. The model is fitted on the driver from the
wordings in license_texts.py, varied by rule; its size is fixed.

Defined results: a null or empty text has no paragraphs and no licence; an empty table gives an empty result; repeated rows are judged alike;
very long texts are read whole; families of equal probability are named in the order of their names; columns other than the two named are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import MARKS, NAMES, OTHER_NAMES, OTHERS, PHRASES, TEMPLATES
from .shared import table

UNKNOWN = "unknown"
THRESHOLD, AGREEMENT = 0.6, 0.5
#: Share of a template's n-grams that a line has if the template is whole in it.
WHOLE = 0.9
_WORD = r"[a-z]+|[0-9]+"


def _plain(text: str) -> list[str]:
    return ["#" if w.isdigit() else w for w in re.findall(_WORD, re.sub(r"[A-Z]", lambda m: m[0].lower(), text))]


def _grams_of(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]
    weights: dict[str, list[float]]
    bias: list[float]
    temperature: float
    templates: dict[str, list[list[str]]]


def _varied(words: list[str], rng: np.random.Generator, filler: list[str]) -> list[str]:
    """A copy with words lost at either end or inside, or with other words around it."""
    kept = [w for w in words if rng.random() > 0.08] or words
    pad = lambda: [filler[k] for k in rng.integers(0, len(filler), rng.integers(0, 6))]
    return pad() + kept + pad()


class _Sparse:
    """Rows of features that are present, for products with a dense matrix of weights."""

    def __init__(self, rows: list[list[int]], kinds: int):
        rows = [r or [kinds] for r in rows]  # feature ``kinds`` weighs nothing
        self.columns = np.concatenate([np.array(r, np.int64) for r in rows])
        self.starts = np.cumsum([0, *map(len, rows)])[:-1]
        self.counts = np.array([len(r) for r in rows], np.float32)
        order = np.argsort(self.columns, kind="stable")
        self.row_of = np.repeat(np.arange(len(rows)), self.counts.astype(np.int64))[order]
        self.kinds_met, self.kind_starts = np.unique(self.columns[order], return_index=True)

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.add.reduceat(weights[self.columns], self.starts)

    def turned_times(self, errors: np.ndarray, out: np.ndarray) -> np.ndarray:
        out[self.kinds_met] = np.add.reduceat(errors[self.row_of], self.kind_starts)
        return out


def _wordings(without: tuple[str, ...]) -> dict[str, list[str]]:
    """All wordings of training by family: the texts, and each name in each phrase."""
    named = {f: [p.format(n) for n in NAMES.get(f, ()) for p in PHRASES if p not in without] for f in TEMPLATES}
    return {f: [t for t in [*TEMPLATES[f], *named[f]] if t not in without] if f not in without else [] for f in TEMPLATES}


@cache
def train(copies: int = 2, held_out: int = 1, rounds: int = 300, l1: float = 4e-5, seed: int = 5, without: tuple[str, ...] = ()) -> Model:
    """Multinomial logistic regression over binary n-grams by proximal gradient steps, which keep it sparse; its temperature is chosen on
    held-out copies.

    without: texts, phrases or names of families that are left out, for tests on what training has not seen.
    """
    rng, families = np.random.default_rng(seed), (*TEMPLATES, UNKNOWN)
    filler = sorted({w for o in OTHERS for w in _plain(o)})
    texts = [(_plain(t), families.index(f)) for f, ts in _wordings(without).items() for t in ts]
    texts += [(_plain(t), len(families) - 1) for t in (*OTHERS, *(p.format(n) for n in OTHER_NAMES for p in PHRASES if p not in without))]
    noise = [([filler[k] for k in rng.integers(0, len(filler), 12)], len(families) - 1) for _ in range(200)]
    fitted = texts + noise + [(_varied(w, rng, filler), y) for w, y in texts for _ in range(copies)]
    unseen = [(_varied(w, rng, filler), y) for w, y in texts for _ in range(held_out)]
    index = {g: k for k, g in enumerate(sorted({g for w, _ in texts for g in _grams_of(w) if not MARKS.isdisjoint(g.split())}))}

    def matrix(rows: list[tuple[list[str], int]]) -> tuple[_Sparse, np.ndarray]:
        return _Sparse([sorted(index[g] for g in _grams_of(w) if g in index) for w, _ in rows], len(index)), np.array([y for _, y in rows])

    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    x, y = matrix(fitted)
    hot = np.eye(len(families), dtype=np.float32)[y]
    # a long wording weighs no more than a short one; families, and what is none, weigh alike
    weight = np.sqrt(_USUAL_GRAMS / np.maximum(x.counts, _USUAL_GRAMS)) / np.bincount(y, minlength=len(families))[y]
    weight = (weight / weight.sum()).astype(np.float32)[:, None]
    w, b, slope = np.zeros(
        (len(index) + 1, len(families)), np.float32
    ), np.zeros(len(families), np.float32), np.zeros((len(index) + 1, len(families)), np.float32)
    pace, bias_pace = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    for _ in range(rounds):  # steps by how much each weight's slope has been so far
        error = weight * (softmax(x.times(w) + b) - hot)
        slope = x.turned_times(error, slope)
        pace += slope**2
        step = np.float32(0.3) / np.sqrt(pace)
        w -= step * slope
        w = np.sign(w) * np.maximum(np.abs(w) - step * np.float32(l1), 0)
        w[-1] = 0
        down = error.sum(axis=0)
        bias_pace += down**2
        b -= np.float32(0.3) * down / np.sqrt(bias_pace)
    xv, yv = matrix(unseen)
    z = xv.times(w) + b
    temperature = min((0.25 * k for k in range(1, 25)), key=lambda t: -np.log(softmax(z / t)[np.arange(len(yv)), yv] + 1e-12).mean())
    used = {g: [round(float(v), 4) for v in w[k]] for g, k in index.items() if np.abs(w[k]).max() > _LEAST_WEIGHT}
    templates = {f: [_template(t) for t in (*NAMES.get(f, ()), *TEMPLATES[f]) if t not in without] for f in TEMPLATES if f not in without}
    return Model(families, used, [round(float(v), 4) for v in b], temperature, {f: templates.get(f, []) for f in TEMPLATES})


def _template(text: str) -> list[str]:
    """The n-grams by which a wording is compared: pairs and triples of words, or its only word."""
    words = _plain(text)
    return sorted(_grams_of(words) - set(words)) or words


#: Weights below this are left out.
_LEAST_WEIGHT = 0.01
#: N-grams of a short notice.
_USUAL_GRAMS = 40


def _tokens(paragraph: Column) -> Column:
    lower = F.translate(paragraph, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.transform(F.regexp_extract_all(lower, F.lit(f"({_WORD})"), 1), lambda w: F.when(w.rlike("^[0-9]+$"), F.lit("#")).otherwise(w))


def _grams(words: Column, n: int) -> Column:
    at = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " "))


@cache
def telling_words(threshold: float = THRESHOLD) -> tuple[str, ...]:
    """Words of which every paragraph that ``classify`` gives a family has one.

    A family's probability is at most the logistic of its lead over unknown, and its lead is at most its bias and the positive leads of all
    n-grams made of the other words. Words are set aside, cheapest first, as long as no family can pass the threshold by them.
    """
    m, unknown = train(), len(TEMPLATES)
    lead = {g: np.maximum(np.array(w) - w[unknown], 0)[:unknown] for g, w in m.weights.items()}
    most = (np.array(m.bias) - m.bias[unknown])[:unknown]
    needed = m.temperature * np.log(threshold / (1 - threshold)) - 1e-6 if 0 < threshold < 1 else -np.inf
    words = sorted({w for g in lead for w in g.split()}, key=lambda w: (w in MARKS, float(lead[w].max()) if w in lead else 0.0, w))
    grams: dict[str, list[str]] = {w: [g for g in lead if w in g.split()] for w in words}
    aside: set[str] = set()
    for w in words:
        added = sum((lead[g] for g in grams[w] if set(g.split()) <= aside | {w}), np.zeros(unknown))
        if (most + added < needed).all():
            most, aside = most + added, aside | {w}
    return tuple(w for w in words if w not in aside)


def _tells(text: Column, threshold: float) -> Column:
    """Whether a text has one of the telling words, as classify() cuts words. False only where classify() is sure to say unknown."""
    m, listed = train(), telling_words(threshold)
    if not 0 < threshold < 1 or max(m.bias) > m.bias[-1]:
        return F.lit(True)
    by_letter: dict[str, list[str]] = {}
    for w in sorted(set(listed) - {"#"}, reverse=True):
        by_letter.setdefault(w[0], []).append(w[1:])
    letters = "|".join(f"{a}(?:{'|'.join(rest)})" for a, rest in by_letter.items())
    return F.coalesce(text.rlike(rf"(?i)(?<![a-z])(?:{letters})(?![a-z])" + ("|[0-9]" if "#" in listed else "")), F.lit(False))


def classify(paragraph: Column, model: Model | None = None, threshold: float = THRESHOLD, agreement: float = AGREEMENT) -> Column:
    """struct<family, probability, agreement, whole> of one paragraph: unknown unless its probability and its templates both speak for the family.

    agreement is the share of n-grams common with the best template, of the fewer of the two; whole says that nearly all of the template is there.
    """
    m = model or train()
    # written as literals, so that the plan holds one constant of each
    weights = F.expr("map(" + ", ".join(f"'{g}', array({', '.join(f'{v}D' for v in w)})" for g, w in m.weights.items()) + ")")
    features = F.array(*[F.lit(g) for g in m.weights])
    listed = {f: ", ".join("array(" + ", ".join(f"'{g}'" for g in t) + ")" for t in ts) for f, ts in m.templates.items()}
    templates = F.expr("map(" + ", ".join(f"'{f}', array({t})" for f, t in listed.items()) + ")")
    bias = F.array(*[F.lit(v) for v in m.bias])

    def score(grams: Column) -> Column:
        return F.aggregate(grams, bias, lambda acc, g: F.zip_with(acc, weights[g], lambda a, b: a + b))

    def probabilities(z: Column) -> Column:
        shares = lambda e: _let(F.aggregate(e, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(e, lambda v: v / total))
        return _let(F.array_max(z), lambda top: _let(F.transform(z, lambda v: F.exp((v - top) / m.temperature)), shares))

    def named(words: Column, p: Column) -> Column:
        def judged(best: Column, family: Column) -> Column:
            def compared(grams: Column) -> Column:
                def shares(t: Column) -> Column:
                    fewer = F.greatest(F.least(F.size(t), F.size(grams)), F.lit(1))
                    return _let(
                        F.size(F.array_intersect(grams, t)), lambda n: F.struct((n / fewer).alias("share"), (n >= WHOLE * F.size(t)).alias("whole"))
                    )

                return F.array_max(F.transform(F.coalesce(templates[family], F.array().cast("array<array<string>>")), shares))

            def verdict(a: Column) -> Column:
                share, known = F.coalesce(a["share"], F.lit(0.0)), (family != UNKNOWN) & (best >= threshold)
                return F.struct(
                    F.when(known & (share >= agreement), family).otherwise(UNKNOWN).alias("family"), best.alias("probability"),
                    share.alias("agreement"), F.coalesce(a["whole"], F.lit(False)).alias("whole"),
                )

            return _let(_let(F.array_distinct(F.concat(words, _grams(words, 2), _grams(words, 3))), compared), verdict)

        return _let(
            F.array_max(p), lambda best: _let(F.element_at(families, F.array_position(p, best).cast("int")), lambda family: judged(best, family))
        )

    families = F.array(*[F.lit(f) for f in m.families])
    in_words = lambda w: _let(F.array_intersect(F.array_distinct(F.concat(w, _grams(w, 2), _grams(w, 3))), features), lambda g: _let(score(g), lambda z: _let(probabilities(z), lambda p: named(w, p))))
    return _let(_tokens(paragraph), in_words)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once: a column that stands in several places would be evaluated in each."""
    return F.transform(F.array(value), use)[0]


#: What sets paragraphs apart: a line break and lines without anything but white space.
_BLANK = r"\n(?:[^\S\n]*\n)+"


def _found(paragraph: Column, threshold: float, agreement: float) -> Column:
    """array<struct<family, probability, agreement, whole>> of a paragraph: see the module's text."""
    known = lambda c: c["family"] != UNKNOWN
    wrapped = F.contains(paragraph, F.lit("\n")).cast("int")  # then the paragraph as a whole comes before its lines
    units = F.filter(F.split(paragraph, "\n"), lambda x: _tells(x, threshold))
    units = F.when(wrapped == 1, F.concat(F.array(paragraph), units)).otherwise(units)

    def chosen(judged: Column) -> Column:
        whole = F.filter(F.slice(judged, 1, wrapped), known)
        lines = F.filter(F.slice(judged, wrapped + 1, F.size(judged)), known)
        return _let(
            F.filter(lines, lambda c: c["whole"]), lambda sure: F.when(F.size(sure) > 0, sure).when(F.size(whole) > 0, whole).otherwise(lines)
        )

    return _let(F.transform(units, lambda x: classify(x, None, threshold, agreement)), chosen)


def _marked(text: Column, threshold: float) -> Column:
    """The paragraphs of a text, with their places from 0, that could carry a licence."""
    numbered = F.transform(F.split(text, _BLANK), lambda x, i: F.struct(i.alias("paragraph"), x.alias("text")))
    none = F.array().cast("array<struct<paragraph: int, text: string>>")
    return F.when(_tells(text, threshold), F.filter(numbered, lambda p: _tells(p["text"], threshold))).otherwise(none)


def paragraphs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, agreement: float = AGREEMENT
) -> DataFrame:
    """(id, paragraph, text, family, probability, agreement), a row for each family of a paragraph that carries a known licence; paragraph
    counts from 0.
    """
    rows = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("t")).where(_tells(F.col("t"), threshold))
    marked = rows.select("id", F.explode(_marked(F.col("t"), threshold)).alias("p")).select("id", "p.*")
    best = marked.withColumn("c", F.explode(_found(F.col("text"), threshold, agreement))).select("id", "paragraph", "text", "c.*")
    return best.groupBy("id", "paragraph", "text", "family").agg(F.max("probability").alias("probability"), F.max("agreement").alias("agreement"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, agreement: float = AGREEMENT) -> DataFrame:
    """(id, n_paragraphs, n_licensed, families, family, probability) of every row.

    n_paragraphs counts paragraphs with anything but white space, n_licensed those with a family; families are in order of name, and family
    is the one of the surest finding, else unknown. All in one row, so nothing is shuffled.
    """
    text = F.coalesce(docs[f"`{text_col}`"], F.lit(""))
    # a paragraph begins with the first line of the text, or after a blank one, that has a character which is no white space
    begins = F.lit(r"(?:\A|\n[^\S\n]*\n)\s*\S")
    rows = docs.select(docs[f"`{id_col}`"].alias("id"), text.alias("t"), F.regexp_count(text, begins).cast("long").alias("n_paragraphs"))
    per_paragraph = F.filter(F.transform("marked", lambda p: _found(p["text"], threshold, agreement)), lambda cs: F.size(cs) > 0)
    rows = rows.select(
        "id", "n_paragraphs", _marked(F.col("t"), threshold).alias("marked")
    ).select("id", "n_paragraphs", per_paragraph.alias("licensed"))
    rows = rows.select("id", "n_paragraphs", F.size("licensed").cast("long").alias("n_licensed"), F.flatten("licensed").alias("found"))
    best = F.array_max(F.transform("found", lambda c: F.struct(c["probability"].alias("p"), c["family"].alias("f"))))
    return rows.select(
        "id", "n_paragraphs", "n_licensed",
        F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda c: c["family"]))), ",").alias("families"),
        F.coalesce(best["f"], F.lit(UNKNOWN)).alias("family"), F.round(F.coalesce(best["p"], F.lit(0.0)), 6).alias("probability"),
    )


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {"op10_licenses": op10_licenses}
