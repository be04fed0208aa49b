"""The language of a text, sentence by sentence: writing system, and hashed letter trigrams.

Letters of one writing system count together; a text in Han and Kana is Japanese. Languages
that share the Latin alphabet are told apart by a multinomial model on hashed letter trigrams,
trained on a bounded sample: frequent function words label its plainest sentences, and the
trigrams learnt from these label all, once more. All steps work on arrays of code points.
"""

from __future__ import annotations

import functools

import numpy as np

WIDTH = 1 << 15
# Frequent function words, which label the first sentences.
_FUNCTION_WORDS = {
    "en": "the of and is are was were with which that this these those how what for from we have has if then there each because hence therefore",
    "fr": "le la les des du est et une un pour avec donc que qui dans sur par au aux en ce cette il elle nous sont combien où chaque alors puis avant",
    "es": "el la los las es una un y para con por que qué en del al se lo su sus como más cuántas cuántos cuál son esto esta este entonces luego cada antes",
    "de": "der die das den dem des ist und ein eine einen für mit auf von zu im wir wie viele danach dann so auch nicht sich bei aus durch",
}
LATIN = tuple(_FUNCTION_WORDS)
# First and last code points of writing systems.
_SYSTEMS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "ru": ((0x400, 0x52F),),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x77F), (0xFB50, 0xFDFF)),
    "devanagari": ((0x900, 0x97F),),
    "thai": ((0xE00, 0xE7F),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF),),
    "zh": ((0x2E80, 0x2FDF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)),
}
_NAMES = [*_SYSTEMS, "other"]
_ENDS = np.array(sorted(map(ord, ".!?。！？;；\n")), np.uint32)
#: Words that a character of a system without blanks stands for.
_DENSITY = {"zh": 0.6, "kana": 0.6, "thai": 0.2}


@functools.cache
def _system() -> np.ndarray:
    """Writing system of every code point, -1 for what is no letter."""
    out = np.full(0x110000, -1, np.int8)
    letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    out[letters] = len(_NAMES) - 1
    for k, ranges in enumerate(_SYSTEMS.values()):
        for a, b in ranges:
            out[a : b + 1][letters[a : b + 1]] = k
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(f" {text.lower()} \n".encode("utf-32-le", "surrogatepass"), np.uint32)


#: Code points that are handled at once.
_CHUNK = 1 << 18


def _trigrams(points: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """Hashed trigrams around each letter: the one before, itself, the one after; blanks where no letter."""
    shown = np.where(letter, points, 0).astype(np.uint32)
    at = np.flatnonzero(letter)
    h = (shown[at - 1] * np.uint32(0x9E3779B1) + shown[at]) * np.uint32(0x85EBCA6B) + shown[at + 1]
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(17)).astype(np.int32)


class Languages:
    """Log weights of hashed trigrams for the languages of the Latin alphabet."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    @classmethod
    def learn(cls, texts: list[str]) -> Languages:
        """From the sentences of a bounded sample."""
        listed = {w: [LATIN.index(c) for c in LATIN if w in _FUNCTION_WORDS[c].split()] for c in LATIN for w in _FUNCTION_WORDS[c].split()}
        grams, labels = [], []
        for text in texts:
            for sentence in text.replace("\n", ". ").split(". "):
                votes = np.zeros(len(LATIN))
                for word in sentence.lower().split():
                    for k in listed.get(word.strip(",:()\"'"), ()):
                        votes[k] += 1
                points = _points(sentence)
                letter = _system()[points] == 0
                if letter.any():
                    grams.append(_trigrams(points, letter))
                    order = np.sort(votes)
                    labels.append(int(votes.argmax()) if order[-1] >= 2 and order[-1] >= order[-2] + 2 else -1)
        weights = np.zeros((WIDTH, len(LATIN)), np.float32)
        if not grams:
            return cls(weights)
        labels, flat = np.array(labels), np.concatenate(grams)
        sizes = np.array([len(g) for g in grams])
        starts = np.cumsum(sizes) - sizes
        for _ in range(2):
            owner = np.repeat(labels, sizes)
            counts = np.stack([np.bincount(flat[owner == k], minlength=WIDTH) for k in range(len(LATIN))], 1) + 0.1
            weights = np.log(counts / counts.sum(0)).astype(np.float32)
            scores = np.add.reduceat(weights[flat], starts, axis=0)
            order = np.sort(scores, 1)
            labels = np.where(order[:, -1] >= order[:, -2] + 5, scores.argmax(1), -1)
        return cls(weights)

    def read(self, text: str) -> dict[str, float]:
        """Words by language; sentences that no language clearly wins do not count."""
        return self.read_all([text])[0]

    def read_all(self, texts: list[str]) -> list[dict[str, float]]:
        """read() of many texts, some hundred thousand code points at a time."""
        out: list[dict[str, float]] = [{} for _ in texts]
        chunk: list[np.ndarray] = []
        owners: list[int] = []
        size = 0
        for k, text in enumerate(texts):
            for start in range(0, len(text), _CHUNK):
                part = _points(text[start : start + _CHUNK])
                if size + len(part) > _CHUNK and chunk:
                    self._read(chunk, owners, out)
                    chunk, owners, size = [], [], 0
                chunk.append(part)
                owners.append(k)
                size += len(part)
        if chunk:
            self._read(chunk, owners, out)
        return out

    def _read(self, parts: list[np.ndarray], owners: list[int], out: list[dict[str, float]]) -> None:
        points = np.concatenate(parts)
        system = _system()[points]
        letter = system >= 0
        at = np.flatnonzero(letter)
        if not len(at):
            return
        ends = np.isin(points, _ENDS)  # every part ends with one
        sentence = np.cumsum(ends) - ends
        n = int(sentence[-1]) + 1
        owner = np.repeat(owners, [int(ends[a:b].sum()) for a, b in zip(np.cumsum([0, *map(len, parts)]), np.cumsum(list(map(len, parts))))])
        s, kind = sentence[at], system[at]
        # words per sentence and system: runs of letters, single letters left out; by density where no blanks are written
        starts = at[~letter[at - 1]]
        long = letter[starts + 1]
        words = np.bincount(sentence[starts[long]] * len(_NAMES) + system[starts[long]], minlength=n * len(_NAMES)).reshape(n, -1).astype(float)
        letters = np.bincount(s * len(_NAMES) + kind, minlength=n * len(_NAMES)).reshape(n, -1)
        for name, density in _DENSITY.items():
            words[:, _NAMES.index(name)] = density * letters[:, _NAMES.index(name)]
        kana, han = _NAMES.index("kana"), _NAMES.index("zh")
        both = words[:, kana] + words[:, han]
        words[:, kana] = np.where(letters[:, kana] * 5 >= letters[:, kana] + letters[:, han], both, 0)
        words[:, han] = np.where(words[:, kana] > 0, 0, both)
        # names and signs are written in Latin letters in texts of other systems too
        other = words.copy()
        other[:, 0] = 0
        main = np.where(other.max(1) * 3 >= np.maximum(words[:, 0], 1e-9), other.argmax(1), 0)
        for k in np.unique(main[words.any(1)]).tolist():
            rows = np.flatnonzero((main == k) & words.any(1))
            if k:
                self._add(out, owner[rows], _NAMES[k], words[rows].sum(1) if _NAMES[k] not in _DENSITY else words[rows, k])
                continue
            latin = kind == 0
            grams = self.weights[_trigrams(points, letter)[latin]]
            scores = np.stack([np.bincount(s[latin], grams[:, c], n) for c in range(len(LATIN))], 1)[rows]
            order = np.sort(scores, 1)
            clear = order[:, -1] >= order[:, -2] + 2
            best = scores.argmax(1)
            for c in np.unique(best[clear]).tolist():
                these = rows[clear & (best == c)]
                self._add(out, owner[these], LATIN[c], words[these].sum(1))

    @staticmethod
    def _add(out: list[dict[str, float]], owner: np.ndarray, name: str, sizes: np.ndarray) -> None:
        found, at = np.unique(owner, return_inverse=True)
        for k, size in zip(found.tolist(), np.bincount(at, sizes).tolist()):
            if size > 0:
                out[k][name] = out[k].get(name, 0.0) + size
