"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over labelled words. A text is parsed
against it from left to right: the longest match of what is left is one phrase, and a
letter that is nowhere in the language is a phrase of its own. The language that needs
the fewest phrases for a letter wins.

Matches do not cross words: a text is cut into runs of letters, lower-cased and set
between marks, so a phrase also tells how words begin and end, and a word that is met
again costs one look-up.

The automata are fitted on a bounded sample: of each language at most ``most_docs``
labelled documents, the first by a hash of their ids, and of their words the
``most_words`` most frequent; at most ``most_langs`` languages, those with most documents.
Every whole text of every row is parsed.

Defined results: ``und`` and score 0 for a null text, one without a letter, or where
nothing was learned; ties go to the language that sorts first; a null ``doc_id`` is never
learned from and is not held out; with one language the score is 1; other columns are
ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evoframe.llm._common import documents_of, per_batch

MOST_DOCS = 300
MOST_WORDS = 20_000
MOST_LANGS = 200
UNKNOWN = "und"
FOLDS, HELD_OUT = 3, 1

_LETTERS = regex.compile(r"\p{L}+")
_START, _END = "\x02", "\x03"


class SuffixAutomaton:
    """All substrings of the words given, each word between its marks."""

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        for word in words:
            last = 0
            for letter in f"{_START}{word}{_END}":
                last = self._extend(last, letter)

    def _new(self, length: int, link: int, moves: dict[str, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, state: int, letter: str, target: int) -> int:
        twin = self._new(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = twin
        while state != -1 and self.next[state].get(letter) == target:
            self.next[state][letter] = twin
            state = self.link[state]
        return twin

    def _extend(self, last: int, letter: str) -> int:
        known = self.next[last].get(letter)
        if known is not None:  # a word before this one has the same beginning
            return known if self.length[known] == self.length[last] + 1 else self._split(last, letter, known)
        state, new = last, self._new(self.length[last] + 1, 0, {})
        while state != -1 and letter not in self.next[state]:
            self.next[state][letter] = new
            state = self.link[state]
        if state != -1:
            target = self.next[state][letter]
            self.link[new] = target if self.length[target] == self.length[state] + 1 else self._split(state, letter, target)
        return new

    def phrases(self, word: str) -> int:
        """How many longest matches, one after the other, make up the word between its marks."""
        moves, count, state = self.next, 0, 0
        for letter in f"{_START}{word}{_END}":
            to = moves[state].get(letter)
            if to is None:
                count += state != 0
                to = moves[0].get(letter)
                if to is None:  # a letter of no word: a phrase of its own
                    count += 1
                    to = 0
            state = to
        return count + (state != 0)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id, as text, leaves 1 by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def training_words(docs: DataFrame, most_docs: int = MOST_DOCS, most_words: int = MOST_WORDS, most_langs: int = MOST_LANGS) -> DataFrame:
    """``lang, word, n``: the most frequent words of each language's sample."""
    rows = documents_of(docs, "doc_id", "lang", "text")
    rows = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    first = rows.select("doc_id", "lang").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most_docs)
    langs = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).select("lang")
    chosen = first.drop("nth").distinct().join(F.broadcast(langs), "lang", "left_semi")  # most_docs * most_langs rows at most
    texts = rows.join(F.broadcast(chosen.limit(most_docs * most_langs)), ["doc_id", "lang"], "left_semi")

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, text in zip(batch.lang, batch.text):
                found = pd.Series(_LETTERS.findall(text.lower()), dtype=object).value_counts()
                yield pd.DataFrame({"lang": lang, "word": found.index, "n": found.to_numpy()})

    counted = texts.select("lang", "text").mapInPandas(words, "lang string, word string, n long")
    counted = counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    return counted.withColumn("nth", F.row_number().over(top)).where(F.col("nth") <= most_words).drop("nth")


class Languages:
    """The automata of all languages, and the phrases of words met before."""

    def __init__(self, words: dict[str, list[str]], most_kept: int = 500_000):
        self.names = sorted(words)
        self.automata = [SuffixAutomaton(words[name]) for name in self.names]
        self.most_kept, self.place, self.table = most_kept, {}, []

    def _place(self, word: str) -> int:
        at = self.place.get(word)
        if at is None:
            at = self.place[word] = len(self.table)
            self.table.append((len(word), *(a.phrases(word) for a in self.automata)))
        return at

    def judge(self, text: str | None) -> tuple[str, float]:
        words = _LETTERS.findall(text.lower()) if text else ()
        if not words or not self.names:
            return UNKNOWN, 0.0
        if len(self.table) > self.most_kept:
            self.place, self.table = {}, []
        place = self.place
        at = [place[w] if w in place else self._place(w) for w in words]
        uses = np.bincount(at)
        some = np.flatnonzero(uses)
        sums = uses[some] @ np.array([self.table[i] for i in some.tolist()], np.int64)
        rates = sums[1:] / (sums[0] + len(words))
        best = int(np.argmin(rates))
        if len(rates) == 1:
            return self.names[best], 1.0
        second = float(np.delete(rates, best).min())
        return self.names[best], (second - float(rates[best])) / second if second > 0 else 0.0


_LOADED: dict[str, Languages] = {}


def identify(docs: DataFrame, most_docs: int = MOST_DOCS, most_words: int = MOST_WORDS, most_langs: int = MOST_LANGS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row of ``docs``."""
    learned: dict[str, list[str]] = {}
    for row in training_words(docs, most_docs, most_words, most_langs).collect():  # most_words * most_langs at most
        learned.setdefault(row.lang, []).append(row.word)
    learned = {lang: sorted(words) for lang, words in learned.items()}
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(learned))
    key = str(shared.id if hasattr(shared, "id") else id(shared)) + str(hash(frozenset((k, tuple(v)) for k, v in learned.items())))

    def predict(batch: pd.DataFrame) -> pd.DataFrame:
        if key not in _LOADED:
            _LOADED.clear()
            _LOADED[key] = Languages(pickle.loads(shared.value))
        model = _LOADED[key]
        found = [model.judge(text) for text in batch.text]
        out = batch[["doc_id", "held_out"]].astype({"doc_id": "Int64"})
        return out.assign(lang_pred=[f[0] for f in found], score=[f[1] for f in found])

    rows = documents_of(docs, "doc_id", "text").select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(per_batch(predict), "doc_id long, held_out boolean, lang_pred string, score double")
