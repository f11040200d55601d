"""Topics: normal form, custom topics and RAKE keywords."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from heapq import nsmallest

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# English stop words at which candidate phrases are cut.
STOP_WORDS = "a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its itself just me more most my no nor not now of off on once only or other our ours out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your"
PHRASES = 10


def normal_topics(topics: Column) -> Column:
    """Trimmed, lower-case, distinct and sorted; blank ones left out."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(topics, lambda t: F.lower(F.trim(t))), lambda t: t.isNotNull() & (t != ""))))


def stored_topics(json: Column) -> Column:
    """Topics of a JSON text; broken or missing text means none."""
    return F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))


def custom_first(topics: Column, custom: Column) -> Column:
    """Custom topics that contain or are contained in a topic, each once, then the topics that met none."""
    found, wanted = normal_topics(topics), normal_topics(custom)
    partner = lambda t: F.try_element_at(F.filter(wanted, lambda c: F.contains(t, c) | F.contains(c, t)), F.lit(1))
    matched = F.array_distinct(F.filter(F.transform(found, partner), lambda c: c.isNotNull()))
    return F.concat(matched, F.filter(found, lambda t: partner(t).isNull()))


def title_and_abstract(title: Column, abstract: Column) -> Column:
    """The text keywords are taken from: the title twice before an abstract, so that it weighs more."""
    return F.when(F.coalesce(F.trim(abstract), F.lit("")) == "", title).otherwise(F.concat(title, F.lit(". "), title, F.lit(". "), abstract))


def rake(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", most: int = PHRASES) -> DataFrame:
    """(doc_id, rank, phrase, score): keywords by rapid automatic extraction.

    Candidate phrases are runs of words without stop words and punctuation; a word scores its degree
    (summed lengths of the phrases it is in) over its frequency, a phrase the sum of its words. A
    text is scored within its row; nothing is shuffled. Repeated rows are scored each.
    """
    rows = documents.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text")).filter("text IS NOT NULL")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, rank int, phrase string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ranks, phrases, scores = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for rank, (phrase, score) in enumerate(best_phrases(text, most), 1):
                    ids.append(i)
                    ranks.append(rank)
                    phrases.append(phrase)
                    scores.append(score)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(ids, pa.int64())), pa.array(ranks, pa.int32()), pa.array(phrases, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "rank", "phrase", "score"])

    return rows.mapInArrow(run, schema)


_BREAK = re.compile(r"[^\w\s'-]+|_+|[\r\n]+")
_STOPS = frozenset(STOP_WORDS.split())
_EDGE = re.compile(r"[\w]+")


def candidate_phrases(text: str) -> list[tuple[str, ...]]:
    """Runs of words between stop words, punctuation and line ends; a stop word within a hyphenated word cuts too."""
    out: list[tuple[str, ...]] = []
    for stretch in _BREAK.split(text.lower()):
        run: list[str] = []
        for word in stretch.split():
            if word in _STOPS:
                out.append(tuple(run))
                run = []
            elif ("-" in word or "'" in word) and not _STOPS.isdisjoint(_EDGE.findall(word)):
                for part in _cut_word(word):
                    if part is None:
                        out.append(tuple(run))
                        run = []
                    elif part:
                        run.append(part)
            else:
                run.append(word)
        out.append(tuple(run))
    return [run for run in out if any(c.isalpha() for word in run for c in word)]


def _cut_word(word: str) -> Iterator[str | None]:
    """Parts of a word around the stop words in it, each of which is given as None."""
    at = 0
    for m in _EDGE.finditer(word):
        if m.group() in _STOPS:
            yield word[at : m.start()]
            yield None
            at = m.end()
    yield word[at:]


def best_phrases(text: str, most: int = PHRASES) -> list[tuple[str, float]]:
    """The ``most`` phrases of the greatest scores, ties in the order of the phrase."""
    phrases = candidate_phrases(text)
    degree: Counter[str] = Counter()
    count: Counter[str] = Counter()
    for run in phrases:
        for word in run:
            degree[word] += len(run)
            count[word] += 1
    scores = {" ".join(run): sum(degree[w] / count[w] for w in run) for run in set(phrases)}
    return nsmallest(most, scores.items(), key=lambda x: (-x[1], x[0]))
