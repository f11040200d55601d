"""Per-document text statistics and how far a text is from natural prose (problem 10).

Statistics are counted in the JVM over whole texts. For each language the mean and covariance of
prose are estimated robustly: from medians, then by concentration steps that keep the documents
near the current estimate; a language of few documents leans towards the estimate of all. The
squared Mahalanobis distance of a document splits into one contribution per statistic.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackmill.session import cut

# The most common words of each language, in the order of their frequency.
COMMON_WORDS = {
    "en": "the of and to a in is it that was for on with as by be are this which or an at from not were had have but about we our has been will than into what there when most if before after could who us said one only its they their you he she his her so no can more would up out all some my me them then these those any where how also did do does very such other over just because while between both each few during under again once here",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an war aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum aber haben wir man wurde ohne oder zur vor bis mehr durch nur sein wenn ich ihr sehr kann gegen vom können schon ihm seine mir einen ihn hatte damit daran nichts jemand keine unter weil wer zwischen",
    "fr": "le la les de des du et en un une à que qui est pour dans par sur au il ne pas plus ce se sont avec on été ont nous mais encore où était reste après l d qu n s c elle ils leur aux sa son ses cette ces comme tout ou y a avant donc sans faut car même être fait très bien si ni",
    "es": "el la los las de del y en un una que es por con para se no al lo su más como pero fue ha han o qué eso esta este si antes después porque eran le les sus ya muy sin sobre entre también hasta hay donde cuando todo nos ni desde ser era otra otros junto sea",
}
LANGUAGES = list(COMMON_WORDS)
NOT_WORD = r"[^\p{L}\p{M}]+"
SYMBOL = r"[^\p{L}\p{M}\p{N}\s.,;:!?'\"()’“”«»¿¡-]"
DIGIT, NOT_BLANK = r"\p{N}", r"\S+"
LINE_END = r"[.!?…:;]['\"”’»)\]]*\s*$"
#: A line reads as prose when this share of its words is common in the document's language.
PROSE_LINE = 0.2
#: The statistics that enter the distance, and the least standard deviation each is taken to have.
STATISTICS = {"log_words": 1.0, "mean_word_length": 0.5, "symbol_ratio": 0.02, "digit_ratio": 0.02, "line_end_share": 0.3, "common_share": 0.05, "prose_share": 0.09, "repeat_share": 0.1, "unspaced": 0.3}
STEPS, KEPT_SHARE = 4, 0.6
#: The estimate of all documents weighs as many documents as this in each language's own.
POOLED_ROWS = 60
#: Squared distance beyond which a text is no natural prose: the 1 - 1e-5 quantile of chi-square with nine degrees of freedom, rounded up.
CUTOFF = 40.0


def _quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _words(*languages: str) -> str:
    return ", ".join(map(_quoted, sorted({w for k in languages for w in COMMON_WORDS[k].split()})))


def _ratio(a: str, b: str) -> str:
    return f"coalesce(try_divide(cast({a} AS double), cast({b} AS double)), 0D)"


def _summed(part: str) -> str:
    """Sum over the lines of what ``part`` says of a line ``p``."""
    return f"aggregate(parts, 0L, (acc, p) -> acc + {part})"


def text_statistics(documents: DataFrame) -> DataFrame:
    """(doc_id, language, words, ...) with every statistic of ``STATISTICS`` and the plain counts.

    A null text counts as empty; an empty text has counts and shares of 0. ``language`` is the one
    whose common words make up most of the text; ties and texts without any go to the first of
    ``LANGUAGES``. The lang column, which is not always right, only serves to tell (``judged``)
    documents of a language that has no word list here.
    """
    other = F.lit(False)
    if "lang" in documents.columns:
        code = F.lower(F.regexp_extract(F.col("lang"), r"^\s*([A-Za-z]{2,3})(?![A-Za-z])", 1))
        other = F.coalesce(~code.isin("", *LANGUAGES), F.lit(False))
    base = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("t"), (~other).alias("judged"))
    # Every line once: its words, and how many of them are in the word list of each language.
    lines = base.selectExpr("*", "filter(split(t, '[\\\\r\\\\n]+'), s -> trim(s) != '') AS lines")
    plain = f"transform(lines, s -> named_struct('n', length(s), 'ended', s rlike {_quoted(LINE_END)}, 'plain', regexp_replace(s, {_quoted(NOT_WORD)}, ' ')))"
    cut_up = "transform(plain, p -> named_struct('n', p.n, 'ended', p.ended, 'letters', length(replace(p.plain, ' ', '')), 'w', filter(split(p.plain, ' '), x -> x != '')))"
    usual = f"transform(cut_up, p -> named_struct('n', p.n, 'ended', p.ended, 'letters', p.letters, 'words', size(p.w), 'c', filter(p.w, x -> x IN ({_words(*LANGUAGES)}))))"
    counts = ", ".join(f"'{k}', size(filter(p.c, x -> x IN ({_words(k)})))" for k in LANGUAGES)
    parts = f"transform(usual, p -> named_struct('n', p.n, 'ended', p.ended, 'letters', p.letters, 'words', p.words, {counts}))"
    for name, expression in (("plain", plain), ("cut_up", cut_up), ("usual", usual), ("parts", parts)):
        lines = lines.withColumn(name, F.expr(expression))
    sums = lines.select("doc_id", "judged", "t", "parts", *[F.expr(f"{_summed('p.' + c)} AS {name}") for c, name in [("words", "words"), ("letters", "letters"), ("n", "weight"), *[(k, f"n_{k}") for k in LANGUAGES]]])
    most = f"greatest({', '.join(f'n_{k}' for k in LANGUAGES)})"
    language = "CASE " + " ".join(f"WHEN n_{k} = common THEN '{k}'" for k in LANGUAGES) + " END"
    blanks = "t"
    for point in (32, 9, 10, 11, 12, 13):
        blanks = f"replace({blanks}, chr({point}))"
    sums = sums.withColumn("common", F.expr(most)).withColumn("language", F.expr(language)).withColumn("solid", F.expr(f"length({blanks})"))
    sums = sums.withColumn("sentences", F.expr("filter(split(t, '[.!?\\\\r\\\\n|]+\\\\s*'), s -> length(s) >= 12)"))
    own = "CASE language " + " ".join(f"WHEN '{k}' THEN p.{k}" for k in LANGUAGES) + " END"
    prose = _summed(f"IF({own} > 0 AND {own} >= p.words * {PROSE_LINE}D, p.n, 0)")
    lengths = lambda a: f"aggregate({a}, 0L, (acc, s) -> acc + length(s))"
    return sums.selectExpr(
        "doc_id",
        "judged",
        "language",
        "cast(words AS int) AS words",
        "size(parts) AS line_count",
        "cast(letters AS int) AS letter_count",
        "log1p(words) AS log_words",
        f"{_ratio('letters', 'words')} AS mean_word_length",
        f"{_ratio(f'regexp_count(t, {_quoted(SYMBOL)})', 'solid')} AS symbol_ratio",
        f"{_ratio('regexp_count(t, ' + _quoted(DIGIT) + ')', 'solid')} AS digit_ratio",
        f"{_ratio(_summed('IF(p.ended, 1, 0)'), 'size(parts)')} AS line_end_share",
        f"{_ratio('common', 'words')} AS common_share",
        f"{_ratio(prose, 'greatest(weight, 1L)')} AS prose_share",
        f"1 - IF(size(sentences) > 0, {_ratio(lengths('array_distinct(sentences)'), lengths('sentences'))}, 1D) AS repeat_share",
        f"log1p({_ratio('solid', 'regexp_count(t, ' + _quoted(NOT_BLANK) + ')')}) AS unspaced",
    )


Model = dict[str, tuple[list[float], list[float]]]
Moments = dict[str | None, tuple[int, np.ndarray, np.ndarray]]


def _moments(rows: DataFrame) -> Moments:
    """Count, mean and covariance per language and (under None) over all; a few numbers per language."""
    names = list(STATISTICS)
    sums = [f"sum({c}) AS s{i}" for i, c in enumerate(names)]
    products = [f"sum({a} * {b}) AS p{i}_{j}" for i, a in enumerate(names) for j, b in enumerate(names) if j >= i]
    found = rows.groupBy("language").agg(*map(F.expr, ["count(*) AS n", *sums, *products])).collect()
    raw = {}
    for r in found:
        s = np.array([r[f"s{i}"] for i in range(len(names))])
        p = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(len(names))] for i in range(len(names))])
        raw[r["language"]] = (r["n"], s, p)
    if raw:
        raw[None] = tuple(sum(x[k] for x in raw.values()) for k in range(3))  # type: ignore[assignment]
    return {k: (n, s / n, p / n - np.outer(s / n, s / n)) for k, (n, s, p) in raw.items() if n}


def _model(moments: Moments) -> Model:
    """Mean and precision per language, each mixed with POOLED_ROWS documents' worth of the estimate of all."""
    floor = np.diag(np.array(list(STATISTICS.values())) ** 2)
    none = (0, np.zeros(len(STATISTICS)), np.zeros_like(floor))
    _, pooled_mean, pooled_cov = moments.get(None, none)
    out = {}
    for language in LANGUAGES:
        n, mean, cov = moments.get(language, none)
        share = n / (n + POOLED_ROWS)
        mean, cov = share * mean + (1 - share) * pooled_mean, share * cov + (1 - share) * pooled_cov
        out[language] = (mean.tolist(), np.linalg.inv(cov + floor).ravel().tolist())
    return out


def _by_language(model: Model, term: Callable[[list[str], np.ndarray], str]) -> str:
    """``term`` of the deviations and the precision of the document's language, as plain arithmetic in SQL."""
    branches = []
    for language, (mean, precision) in model.items():
        deviations = [f"({c} - {_number(m)})" for c, m in zip(STATISTICS, mean, strict=True)]
        branches.append(f"WHEN '{language}' THEN {term(deviations, np.array(precision).reshape(len(mean), -1))}")
    return f"CASE language {' '.join(branches)} END"


def _number(x: float) -> str:
    return f"({float(x)!r}D)"


def _distances(rows: DataFrame, model: Model) -> DataFrame:
    """Adds ``distance``: the squared length of the deviations after the Cholesky factor of the precision."""

    def length(d: list[str], precision: np.ndarray) -> str:
        factor = np.linalg.cholesky(precision)
        sums = [" + ".join(f"{d[i]} * {_number(factor[i, k])}" for i in range(k, len(d))) for k in range(len(d))]
        return " + ".join(f"pow({x}, 2)" for x in sums)

    return rows.withColumn("distance", F.expr(_by_language(model, length)))


def _contributions(model: Model) -> list[Column]:
    """What each statistic adds to the squared distance: its deviation times its row of the precision."""
    part = lambda i: _by_language(model, lambda d, p: f"{d[i]} * ({' + '.join(f'{d[j]} * {_number(p[i, j])}' for j in range(len(d)))})")
    return [F.expr(part(i)).alias(f"from_{c}") for i, c in enumerate(STATISTICS)]


def prose_model(rows: DataFrame) -> Model:
    """Robust mean and precision of prose per language, over all documents.

    Start: medians and median absolute deviations. Each concentration step keeps the KEPT_SHARE of a
    language's documents that are nearest to the estimate (by an approximate quantile of their
    distances) and estimates again.
    """
    # Prose holds common words; the start only looks at texts with some, or their lists would set the medians.
    start = rows.filter("common_share >= 0.2")
    names = list(STATISTICS)
    medians = start.groupBy("language").agg(F.count("*").alias("n"), *[F.percentile_approx(c, 0.5, 1000).alias(c) for c in names]).collect()
    if not medians:
        return _model({})
    model = {r["language"]: (r["n"], np.array([r[c] for c in names], dtype=float), np.zeros((len(names), len(names)))) for r in medians}
    pooled = sum(v[0] * v[1] for v in model.values()) / sum(v[0] for v in model.values())
    state = _model({**model, None: (POOLED_ROWS, pooled, np.zeros((len(names), len(names))))})
    for _ in range(STEPS):
        near = _distances(rows, state)
        limits = near.groupBy("language").agg(F.percentile_approx("distance", KEPT_SHARE, 1000).alias("limit")).collect()
        kept = F.coalesce(*[F.when(F.col("language") == r["language"], F.col("distance") <= r["limit"]) for r in limits], F.lit(False))
        state = _model(_moments(near.filter(kept)))
    return state


def quality(documents: DataFrame) -> DataFrame:
    """One row per document: counts, statistics, ``distance``, ``natural`` and one ``from_<statistic>`` per statistic.

    ``distance`` is the squared robust Mahalanobis distance from prose of the document's language and
    ``from_...`` are its parts, which sum to it. ``natural`` is null where ``judged`` is false: the
    document's lang names a language without a word list here, so its distance says nothing.
    Documents without an id are kept; repeated rows are measured each; an empty table gives no rows.
    """
    rows = cut(text_statistics(documents))
    model = prose_model(rows.filter("judged"))
    out = _distances(rows, model)
    return out.select("doc_id", "language", "judged", "words", "line_count", "letter_count", *STATISTICS, "distance", F.when(F.col("judged"), F.col("distance") <= CUTOFF).alias("natural"), *_contributions(model))


def unnatural(measured: DataFrame) -> DataFrame:
    """(doc_id) of the documents that are no natural prose."""
    return measured.filter("NOT natural").select("doc_id").distinct()
