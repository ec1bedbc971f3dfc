"""Language of a text: its script, then a naive Bayes model of words and letter pairs of the script's languages."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarryweb.operators.profiles import ALONE, LATIN, SAMPLES, SHARED

_LETTERS = re.compile(r"[^\W\d_]+(?:['ʻ’][^\W\d_]+)*")
#: Japanese needs this share only, as it mixes two scripts.
MIXED_SHARE, SCRIPT_SHARE = 0.1, 0.5


class Model:
    """Languages of one script, trained on their lists of words, most frequent first, and samples.

    Listed words follow Zipf's rule. A word is a listed one (LISTED of words
    are) or is spelled by letter pairs, of which half is what the pairs of the
    training words tell and half the letter alone. A text's score in a
    language is the sum over its words; pairs of words in no list are counted
    together, so the cost is that of counting.
    """

    LISTED, PAIRS = 0.45, 0.5

    def __init__(self, languages: dict[str, tuple[str, str]]):
        self.codes = list(languages)
        n = len(self.codes)
        self.listed: dict[str, np.ndarray] = {}
        self.pairs: list[Counter] = []
        letters = []
        for i, (code, (words, special)) in enumerate(languages.items()):
            ranked = list(dict.fromkeys(words.split()))
            weights = [1 / (r + 3) for r in range(len(ranked))]
            training = Counter({w: 8 * x for w, x in zip(ranked, weights, strict=True)})
            for word in _LETTERS.findall(SAMPLES.get(code, "").lower()):
                training[word] += 1
            for word, x in zip(ranked, weights, strict=True):
                self.listed.setdefault(word, np.zeros(n))[i] = x / sum(weights)
            pairs, each = Counter(), Counter()
            for word, x in training.items():
                for pair in zip(f" {word}", f"{word} ", strict=True):
                    pairs[pair] += x
                    each[pair[1]] += x
            # Letters that a language is known by are one in fifty together, if the training words lack them.
            total = sum(each.values())
            for c in special.lower():
                each[c] += total / 50 / len(special)
            self.pairs.append(pairs)
            letters.append(each)
        signs = {c for x in letters for c in x}
        few = 0.02
        self.letters = [{c: (x[c] + few) / (sum(x.values()) + few * (len(signs) + 30)) for c in signs} for x in letters]
        self.least = [few / (sum(x.values()) + few * (len(signs) + 30)) for x in letters]
        self.first = [Counter() for _ in self.codes]
        for first, pairs in zip(self.first, self.pairs, strict=True):
            for (a, _), x in pairs.items():
                first[a] += x
        self.known: dict[tuple[str, str], np.ndarray] = {}
        self.words = {w: np.log(self.LISTED * p + (1 - self.LISTED) * np.exp(self._spelled(Counter(zip(f" {w}", f"{w} ", strict=True))))) for w, p in self.listed.items()}

    def _pair(self, pair: tuple[str, str]) -> np.ndarray:
        a, b = pair
        out = []
        for i in range(len(self.codes)):
            base, seen = self.letters[i].get(b, self.least[i]), self.first[i][a]
            out.append(math.log((1 - self.PAIRS) * base + self.PAIRS * (self.pairs[i][pair] / seen if seen else base)))
        if len(self.known) < 20_000:
            self.known[pair] = np.array(out)
        return np.array(out)

    def _spelled(self, pairs: Counter) -> np.ndarray:
        total = np.zeros(len(self.codes))
        for pair, k in pairs.items():
            at = self.known.get(pair)
            total += k * (self._pair(pair) if at is None else at)
        return total

    def best(self, words: list[str]) -> tuple[str, float]:
        """(code, how much likelier than the next language the text is, by its words' average and number)."""
        other = [w for w in words if w not in self.words]
        text = f" {' '.join(other)} "
        totals = self._spelled(Counter(zip(text, text[1:], strict=False))) if other else np.zeros(len(self.codes))
        totals += len(other) * math.log(1 - self.LISTED)
        for word, k in Counter(w for w in words if w in self.words).items():
            totals += k * self.words[word]
        second, top = np.sort(totals)[-2:]
        return self.codes[int(totals.argmax())], float(1 - math.exp((second - top) / math.sqrt(len(words))))


_MODELS: dict[str, Model] = {}
_SCRIPTS = [(re.compile(f"[{span}]"), code, MIXED_SHARE if code == "jpn" else SCRIPT_SHARE, None) for code, span in ALONE.items()]
_SCRIPTS += [(re.compile(f"[{span}]"), span, SCRIPT_SHARE, languages) for span, languages in SHARED.items()]


def _model(name: str, languages: dict[str, tuple[str, str]]) -> Model:
    """Made once in each worker."""
    if name not in _MODELS:
        _MODELS[name] = Model(languages)
    return _MODELS[name]


def detect(text: str | None) -> tuple[str | None, float | None]:
    """(code, confidence from 0 to 1); nothing for a text without letters."""
    words = _LETTERS.findall((text or "").lower())
    if not words:
        return None, None
    joined = "".join(words)
    if not joined.isascii():
        for signs, name, share, languages in _SCRIPTS:
            found = len(signs.findall(joined)) / len(joined)
            if found > share:
                return (name, min(1.0, found + 0.1)) if languages is None else _model(name, languages).best(words)
    return _model("latin", LATIN).best(words)


def language(text: Column) -> Column:
    """struct<language,confidence> of a text column."""

    @F.arrow_udf("struct<language:string,confidence:double>")
    def run(texts: pa.Array) -> pa.Array:
        found = [detect(x.as_py()) for x in texts]
        return pa.StructArray.from_arrays([pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())], ["language", "confidence"])

    return run.asNondeterministic()(text) if hasattr(run, "asNondeterministic") else run(text)
