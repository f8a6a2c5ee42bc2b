"""Operator 10: language identification by segmentation-marginalised unigrams.

A fixed public vocabulary of pieces has one probability per piece and language.
A word's probability in a language is the sum over all its segmentations into
pieces (forward algorithm); a text's is the product over its words.  The
probabilities are learnt by expectation-maximisation, whose expectation step
runs the forward and the backward algorithm over the training words.

A word is a run of letters and letter-like signs, in lower case, with the
vocabulary's mark for a word's start; however long, it is scored whole, and sums
are scaled on the way so that they never vanish.  A code point that no piece
covers has a small probability that is equal in all languages.

The classifier is fitted on about ``FIT_ROWS`` labelled rows, an equal part of them
for each language (all rows of one that has fewer), and on all their words.

Defined results: a null or empty text, or one without any letter, is ``und``
with score 0; without training rows every text is ``und``; an empty table gives
no rows; ties go to the language that sorts first; repeated rows are scored
each; other columns are kept, columns named like the results are replaced; a
very long text takes memory for its words, a very long word for its own sums.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumigrid.llm.common import small_batches, tidy, written

#: At most about so many labelled rows, and words of so many code points, are used to fit the classifier.
FIT_ROWS = 3000
ROUNDS = 2
#: Longer words are fitted one by one, in logarithms, and scaled while they are scored.
LONGEST = 30
#: Sums of words that are held at once, and the sum below which a word's are scaled.
CELLS, LOW = 100_000, 1e-100
#: Added to each piece's expected count; probability of a code point without piece.
SMOOTHING, STRANGE = 0.02, 1e-9
#: Words after which a worker's memo starts anew.
MEMO = 60_000
MARK = "▁"
_RUN = re.compile(r"[^\W\d_]+")


class Pieces:
    """The vocabulary, and the sums over segmentations of many words at once."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        texts = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_unknown(i) and not model.is_byte(i)}
        self.texts = sorted({t.lower() for t in texts})
        self._build()

    def _build(self) -> None:
        """A trie as arrays, so that many places of a text walk it at once."""
        letters = sorted({c for t in self.texts for c in t})
        self.kinds = len(letters) + 1
        self.kind = np.full(0x110000, len(letters), np.int32)
        self.kind[[ord(c) for c in letters]] = np.arange(len(letters))
        nodes, edges, ends = {"": 0}, [], {}
        for i, t in enumerate(self.texts):
            for n in range(1, len(t) + 1):
                if t[:n] not in nodes:
                    nodes[t[:n]] = len(nodes)
                    edges.append((nodes[t[: n - 1]] * self.kinds + int(self.kind[ord(t[n - 1])]), nodes[t[:n]]))
            ends[nodes[t]] = i
        self.edges, self.target = np.array(sorted(edges), np.int64).T.copy()
        self.longest = max(map(len, self.texts))
        self.piece = np.full(len(nodes), -1)
        self.piece[list(ends)] = list(ends.values())

    def matches(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Of all pieces inside the words: word, end in it, length, piece; sorted by end, then word.

        One more match of length 1 and piece -1 stands at each code point that
        is no piece by itself.
        """
        codes = np.frombuffer("".join([MARK + w for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(w) + 1 for w in words], np.int64)
        of = np.repeat(np.arange(len(words)), lengths)
        stops = np.cumsum(lengths)
        kind, left = self.kind[codes], stops[of] - np.arange(len(codes))
        start, node, n, found = np.arange(len(codes)), np.zeros(len(codes), np.int64), 0, []
        while len(start):
            key = node * self.kinds + kind[start + n]
            at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            goes = self.edges[at] == key
            n += 1
            if n == 1:
                lone = start[~goes | (self.piece[self.target[at]] < 0)]
                found.append((lone, np.ones(len(lone), np.int64), np.full(len(lone), -1)))
            start, node = start[goes], self.target[at[goes]]
            piece = self.piece[node]
            here = piece >= 0
            found.append((start[here], np.full(int(here.sum()), n), piece[here]))
            on = left[start] > n
            start, node = start[on], node[on]
        start, size, piece = (np.concatenate(x) for x in zip(*found))
        word = of[start]
        end = start + size - (stops - lengths)[word]
        order = np.argsort(end * max(1, len(words)) + word, kind="stable")
        return word[order], end[order], size[order], piece[order], lengths

    def forward(self, words: list[str], p: np.ndarray) -> tuple:
        """Log probability of each word by language, with what a backward pass needs.

        ``p``: a row of probabilities for each piece, and a last one for code
        points without piece.  The sums of a word and language are scaled together, those of as
        many places as the longest piece has; words to go back over are too short for that.
        """
        word, end, size, piece, lengths = found = self.matches(words)
        longest = int(lengths.max(initial=1))
        alpha = np.zeros((longest + 1, len(words), p.shape[1]))
        alpha[0] = 1.0
        cuts = np.searchsorted(end, np.arange(1, longest + 2))
        scale = np.zeros((len(words), p.shape[1]))
        for t in range(1, longest + 1):
            part = slice(cuts[t - 1], cuts[t])
            w = word[part]
            if len(w):
                value = alpha[t - size[part], w] * p[piece[part]]
                first = np.flatnonzero(np.diff(w, prepend=-1))
                here, total = w[first], np.add.reduceat(value, first)
                alpha[t, here] = total
                if longest > LONGEST + 1:
                    low, k = np.nonzero((total < LOW) & (total > 0) & (lengths[here] > LONGEST + 1)[:, None])
                    alpha[max(0, t - self.longest) : t + 1, here[low], k] /= total[low, k]
                    scale[here[low], k] += np.log(total[low, k])
        log = np.log(np.maximum(alpha[lengths, np.arange(len(words))], 1e-300)) + scale
        return log, alpha, found, cuts

    def expected(self, words: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected uses of each piece by language; ``counts``: of the words, by language."""
        log, alpha, (word, end, size, piece, lengths), cuts = self.forward(words, p)
        scale = counts / np.exp(log)
        beta = np.zeros_like(alpha)
        beta[lengths, np.arange(len(words))] = 1.0
        uses = np.zeros((len(piece), p.shape[1]))
        for t in range(len(alpha) - 1, 0, -1):
            part = slice(cuts[t - 1], cuts[t])
            w, start = word[part], t - size[part]
            if len(w):
                value = p[piece[part]] * beta[t, w]
                uses[part] = alpha[start, w] * value * scale[w]
                beta[start, w] += value  # one match of a word has this start and end
        return np.stack([np.bincount(piece % len(p), u, len(p)) for u in uses.T], axis=1)

    def expected_of_long(self, text: str, counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """The same for one word of any length, in logarithms."""
        _, end, size, piece, lengths = self.matches([text])
        n, log = int(lengths[0]), np.log(p)
        cuts = np.searchsorted(end, np.arange(1, n + 2))
        before, after = np.full((n + 1, p.shape[1]), -np.inf), np.full((n + 1, p.shape[1]), -np.inf)
        before[0] = after[n] = 0
        parts = [slice(cuts[t - 1], cuts[t]) for t in range(1, n + 1)]
        for t, part in enumerate(parts, 1):
            before[t] = np.logaddexp.reduce(before[t - size[part]] + log[piece[part]], axis=0)
        uses = np.zeros((len(piece), p.shape[1]))
        for t, part in reversed(list(enumerate(parts, 1))):
            start, value = t - size[part], log[piece[part]] + after[t]
            uses[part] = np.exp(before[start] + value - before[n]) * counts
            after[start] = np.logaddexp(after[start], value)  # one match has this start and end
        return np.stack([np.bincount(piece % len(p), u, len(p)) for u in uses.T], axis=1)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def words_of(text: str | None) -> list[str]:
    """Scored words of a text; none if it has no letter."""
    found = _RUN.findall((text or "").lower())
    if not any(map(str.isalpha, found)) and not any(c.isalpha() for w in found for c in w):
        return []
    return found


@dataclass(frozen=True)
class Model:
    path: str
    languages: tuple[str, ...]
    p: np.ndarray


def fitted(docs: DataFrame, path: str, text: str = "text", lang: str = "lang", order: Column | None = None, rows: int = FIT_ROWS, rounds: int = ROUNDS) -> Model:
    """Learns from rows with a language: all, or about ``rows`` of them, as many of each language,
    chosen by a hash of ``order``.

    The sample is written once.  The driver gets the piece counts only: vocabulary times languages numbers.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), (F.xxhash64(F.col(text)) if order is None else F.xxhash64(order)).alias("by"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = tuple(sorted(counts))
    if sum(counts.values()) > rows:
        least = F.coalesce(*[F.when(F.col("lang") == x, F.lit(int((1 << 20) * min(1.0, rows / len(counts) / n)))) for x, n in counts.items()])
        known = known.where(F.pmod("by", F.lit(1 << 20)) < least)
    known = written(known.select("text", "lang")) if languages else known
    size = len(pieces(path).texts)
    p = np.full((size + 1, max(1, len(languages))), 1.0 / size)
    p[-1] = STRANGE
    at = {x: i for i, x in enumerate(languages)}
    for _ in range(rounds if languages else 0):

        def step(batches: Iterator[pd.DataFrame], p: np.ndarray = p) -> Iterator[pd.DataFrame]:
            out = np.zeros_like(p)
            for batch in batches:
                for start in range(0, len(batch), 200):
                    rows_ = batch.iloc[start : start + 200]
                    seen: dict[str, int] = {}
                    pairs = [(seen.setdefault(w, len(seen)), at[x]) for t, x in zip(rows_["text"], rows_["lang"]) for w in words_of(t)]
                    if pairs:
                        k, words = p.shape[1], list(seen)
                        w, x = np.array(pairs).T
                        counts = np.bincount(w * k + x, minlength=len(seen) * k).reshape(-1, k)
                        short = np.array([len(word) <= LONGEST for word in words])
                        if short.any():
                            out += pieces(path).expected([word for word, s in zip(words, short) if s], counts[short], p)
                        for at_ in np.flatnonzero(~short):
                            out += pieces(path).expected_of_long(words[at_], counts[at_], p)
            i, j = np.nonzero(out)
            yield pd.DataFrame({"piece": i, "lang": j, "n": out[i, j]})

        sums = known.mapInPandas(step, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        n_ = np.zeros_like(p)
        n_[sums["piece"], sums["lang"]] = sums["n"]
        p = np.vstack([(n_[:-1] + SMOOTHING) / (n_[:-1].sum(axis=0) + SMOOTHING * size), np.full((1, p.shape[1]), STRANGE)])
    return Model(path, languages, p)


class Scorer:
    """Scores texts in one worker; words met before are looked up."""

    def __init__(self, model: Model):
        self.model, self.at, self.log = model, {}, np.zeros((0, len(model.languages)))

    def add(self, words: list[str]) -> None:
        new = [w for w in dict.fromkeys(words) if w not in self.at]
        logs = [self.log]
        new.sort(key=len)
        while new:
            n = len(new)
            while n > 1 and n * (len(new[n - 1]) + 2) > CELLS:
                n = min(n - 1, max(1, CELLS // (len(new[n - 1]) + 2)))
            part, new = new[:n], new[n:]
            logs.append(pieces(self.model.path).forward(part, self.model.p)[0])
            self.at.update(zip(part, range(len(self.at), len(self.at) + len(part))))
        self.log = np.concatenate(logs)

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.model.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        if len(self.at) > MEMO:
            self.at, self.log = {}, self.log[:0]
        words = [words_of(t) for t in texts]
        self.add([w for x in words for w in x])
        names, scores, at = [], np.zeros(len(texts)), self.at
        for k, x in enumerate(words):
            if not x:
                names.append("und")
                continue
            total = self.log[[at[w] for w in x]].sum(axis=0)
            best = int(total.argmax())
            names.append(self.model.languages[best])
            scores[k] = 1.0 / np.exp(total - total[best]).sum()
        return names, scores


def identified(df: DataFrame, model: Model, text: str = "text", out: str = "lang_pred", score: str = "score") -> DataFrame:
    """``df`` with each text's language and the posterior probability of it."""

    kept = [c for c in df.columns if c not in (out, score)]
    rows = df.select(*kept)
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StringType()), T.StructField(score, T.DoubleType())])
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for start in range(0, len(batch), 300):
                part = batch.slice(start, 300)
                names, scores = scorer(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores)], [*part.schema.names, out, score])

    return small_batches(rows).mapInArrow(tidy(run), schema)


def remainder(key: str, modulus: int) -> Column:
    """crc32 of a key as text, by ``modulus``; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(modulus))
