"""Problem 2: defective question and answer pairs, by a conditional random field over the answer's clauses.

An answer is cut into clauses; a linear-chain field tags each as answer, refusal, echo, foreign or
unfinished; the share of the answer's words under each tag and the tag of the last clause decide the
defect.  What a clause says comes to the field as hashed words, word pairs, word beginnings and word
ends; beside them stand its overlap with the question, the language of clause, answer and question, and
how the answer ends.  The field is trained in numpy on all pairs, in shards of about SHARD_PAIRS by hash of
their key: a first field is fitted to one shard, every shard goes on from it with its own pairs where they
lie, and the field is their mean, weighed by what each learnt from.  A shard learns from its sound answers as they are, defects made from them (cut short, questions said back, answers of another
language) and refusals put together in `refusals`.  A first field learns from the half of the answers
whose words are most those of questions; the other half's answers that it takes for refusals are then learnt
as refusals, in a second trial too, and those it doubts are left out.
How many different answers open with the same two words, how often a last word stands elsewhere, the
languages' words and the words of questions are counted over the whole corpus; a word is one of questions if
it stands once in SHARD_PAIRS pairs or more often.

Defined cases: null, blank and placeholder answers are `empty`; a null question can be neither copied nor
missed in language; of several deliveries of a key the latest counts; rows with a null key give no rows;
with no sound answer to train on only `empty` is found.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.refusals import PATTERNS, assertion, courtesy, refusal
from corpusloom.llm.truncation import closing_words, word_key

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)
SHARD_PAIRS = 1_500
STEPS, TRIAL_STEPS, TRIALS = 80, 40, 3
#: Steps of a shard that goes on from the first field, and their length against those of the first.
NEXT_STEPS, NEXT_PACE = 12, 0.2
#: Expected share of an answer's words from which it is a refusal (half for one of under FEW_WORDS words), and
#: from which it is not learnt from as sound; refusals come in more wordings than the field has met.
REFUSAL_SHARE, FEW_WORDS, DOUBT = 0.2, 4, 0.03
UNFINISHED_CHANCE = 0.5
#: Share of the hashed features that stay in a refusal or a sound answer made for training.
KEPT, KEPT_SOUND = 0.5, 0.8
#: Longer chains are trained on in parts of so many clauses.
TRAIN_CLAUSES = 14
#: Places of the hashed features; the first is met in every clause.
HASHED = 1 << 14
#: Log-likelihood by which one language must lead to count as the answer's, and as the question's.
LEAD, ASKED_LEAD = 5.0, 2.5
SLICE_ROWS = 512

# Placeholders, folded to lower case without accents.
PLACEHOLDERS = {"null", "none", "nan", "na", "nil", "todo", "tbd", "fixme", "pendente", "pendiente", "pending", "sem resposta", "sin respuesta", "no answer", "unknown", "vazio", "empty", "undefined", "n a", "a definir", "xxx", "lorem ipsum", "nd", "n d", "s r", "s resposta"}
#: Words from which the languages are learnt.
SEEDS = {
    "pt": set("o os a as um uma de do da dos das em no na nos nas pelo pela para com sem ao que e ou se nao mais ate seu sua ser foi quando qual quem".split()),
    "en": set("the of and to in on for with without by from as at or not is are be may must shall can that this which who when what".split()),
    "es": set("el los la las un una de del en por para con sin al que y o si no mas hasta su sus ser fue cuando cual quien".split()),
}
CLAUSE = re.compile(r"(?<=[.!?;:,…])\s+|[\r\n]+")
WORDS = re.compile(r"[^\W_]+")
PLACE = re.compile(r"[^\W_](?:[\w-]*[^\W_])?")
ENDED = re.compile(r"(?:[.!?…]|https?://\S+)[)\]\"'”’»*]*$|[.!?)][)\]\"'”’»*]*$")
MARKED = re.compile(r"(?:\.{3,}|…|\[\s*(?:\.{2,}|…)\s*\]|\(\s*(?:\.{2,}|…)\s*\)|�)\s*$")
CLOSED_MARK = re.compile(r"(?i)(?:\betc|sucess?ivamente|assim por diante|and so on)\W*$")
LISTED = re.compile(r"\s*[-•*]\s")
BLANKS = " \t\r\n\f\v             ​‌‍    ⁠　﻿­"
_LOOSE = regex.compile(r"[\p{M}\p{Cf}]+")


def fold(text: str) -> str:
    low = text.lower()
    return low if low.isascii() else _LOOSE.sub("", unicodedata.normalize("NFKD", low))


def words(folded: str) -> list[str]:
    return WORDS.findall(folded)


def is_empty(answer: str | None) -> bool:
    """Null, blank, or only a placeholder or mark."""
    if answer is None:
        return True
    found = words(fold(answer))
    return not found or (len(found) <= 4 and " ".join(found) in PLACEHOLDERS)


class Speech:
    """How likely each language uses a word, learnt from texts that begin unlabelled but for the seeds."""

    def __init__(self, texts: list[list[str]], asked: list[list[str]], rounds: int = 2):
        self.names = list(SEEDS)
        self.weights: dict[str, np.ndarray] = {}
        self._base: dict[str, np.ndarray] = {}
        for k, name in enumerate(self.names):
            for w in SEEDS[name]:
                self._base.setdefault(w, np.zeros(len(self.names)))[k] += 20.0
        self._weigh(self._base)
        #: Words of the questions learnt from.
        self.asked = {w for t in asked for w in t}
        #: How often a word stands in answers and how often it closes a clause there.
        self.stands, self.closes = Counter(), Counter()
        for _ in range(rounds):
            self.learn(self.count(texts))

    def count(self, texts: Iterable[list[str]]) -> dict[str, list[float]]:
        """How often each language has each word, in texts whose language is plain."""
        counts: dict[str, list[float]] = {}
        for text in texts:
            name, lead = self.of(text)
            if lead >= ASKED_LEAD:
                k = self.names.index(name)
                for w in text:
                    if w not in counts:
                        counts[w] = [0.0] * len(self.names)
                    counts[w][k] += 1.0
        return counts

    def learn(self, counts: dict[str, list[float]]) -> None:
        both = {w: v.copy() for w, v in self._base.items()}
        for w, v in counts.items():
            both[w] = both[w] + v if w in both else np.array(v)
        self._weigh(both)

    def _weigh(self, counts: dict[str, np.ndarray]) -> None:
        seen = np.array(list(counts.values()))
        odds = np.log(seen + 0.3) - np.log(seen.sum(axis=0) + 0.3 * len(seen))
        self.weights = dict(zip(counts, np.clip(odds - odds.mean(axis=1, keepdims=True), -3.0, 3.0).tolist()))

    def of(self, found: list[str]) -> tuple[str | None, float]:
        """The leading language and its lead over the next."""
        a = b = c = 0.0
        for w in found:
            v = self.weights.get(w)
            if v:
                a, b, c = a + v[0], b + v[1], c + v[2]
        low, mid, high = sorted(((a, 0), (b, 1), (c, 2)))
        lead = high[0] - mid[0]
        return (self.names[high[1]] if lead > 0 else None), lead


_PLACES: dict[str, tuple[int, ...]] = {}


def _places(word: str) -> tuple[int, ...]:
    """Hashes of a word, its beginning and its end."""
    got = _PLACES.get(word)
    if got is None:
        if len(_PLACES) > 200_000:
            _PLACES.clear()
        plain = "0" if word.isdigit() else word
        got = _PLACES[word] = tuple(zlib.crc32(x.encode()) for x in (["w" + plain] + (["b" + plain[:4]] if len(plain) >= 4 else []) + (["e" + plain[-3:]] if len(plain) >= 5 else [])))
    return got


def hashed(found: list[str]) -> list[int]:
    """Places of a clause's features among HASHED."""
    per = [_places(w) for w in found]
    out = [0]
    for p in per:
        out += p
    out += [a[0] * 31 + b[0] * 17 + 7 for a, b in zip(per, per[1:])]
    return [x % HASHED for x in out]


class Pair:
    """A question and answer prepared for tagging."""

    def __init__(self, question: str | None, answer: str, openings: int, places: int, closing: int, speech: Speech):
        self.answer = answer.strip(BLANKS)
        self.asked = words(fold(question or ""))
        self.openings, self.places, self.closing = openings, places, closing
        self.clauses = [c for c in CLAUSE.split(self.answer) if c.strip(BLANKS)]
        self.words = [words(fold(c)) for c in self.clauses]
        self.hashed = [hashed(w) for w in self.words]
        self.ended = bool(ENDED.search(self.answer))
        self.marked = bool(MARKED.search(self.answer)) and not CLOSED_MARK.search(self.answer)
        self.rows = self._features(speech)

    def _features(self, speech: Speech) -> list[list[float]]:
        asked, pairs = set(self.asked), set(zip(self.asked, self.asked[1:]))
        every = [w for c in self.words for w in c]
        own, lead = speech.of(every)
        theirs, their_lead = speech.of(self.asked)
        strange = float(own is not None and theirs is not None and own != theirs and lead >= LEAD and their_lead >= ASKED_LEAD)
        listed = bool(re.search(r"(?:^|\n)\s*[-•*]\s", self.answer)) and bool(LISTED.match(self.answer.splitlines()[-1])) if self.clauses else False
        self.strange, self.listed = bool(strange), listed
        overlap = sum(w in asked for w in every) / max(1, len(every))
        foreign_to_questions = sum(w not in speech.asked for w in every) / max(1, len(every))
        share = min(1.0, self.closing / max(1, self.places) * 5)
        out = []
        for i, w in enumerate(self.words):
            end = i == len(self.words) - 1
            n = len(w)
            seen = sum(x in asked for x in w) / max(1, n)
            run = sum(p in pairs for p in zip(w, w[1:])) / (n - 1) if n > 1 else seen
            lang, by = speech.of(w)
            open_end = float(end and not self.ended)
            new = sum(x not in speech.asked for x in w) / max(1, n)
            out.append(
                [1.0, seen, run, float(run >= 0.95 and n >= 3), float(run >= 0.95 and n < 3), n / max(1, len(self.asked)) * float(run > 0.9), strange, strange * float(lang == own or lang is None), float(lang is not None and theirs is not None and lang != theirs and by >= LEAD)]
                + [float(end), float(end and self.ended), open_end, float(end and self.marked) * 2, open_end * float(self.answer[-1] in ",;:-"), open_end * float(self.places == 0), open_end * share, open_end * float(listed), open_end * float(listed and self.closing > 0), open_end * float(len(every) <= 6), open_end * float(np.log1p(max(0, self.openings - 1))) / 4, open_end * float(self.openings <= 1), new, new * min(n, 8) / 8, foreign_to_questions, foreign_to_questions * min(len(every), 12) / 12, overlap, overlap * float(len(every) > 6), float(i == 0), float(i == 0 and n <= 2 and self.clauses[i].rstrip().endswith(":")), min(n, 12) / 12, open_end * float(not listed and len(every) > 6)]
            )
        return out


def _lay_out(pairs: list[Pair]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(dense rows, hashed places, their values, first place of each clause) of all clauses in order."""
    dense = np.array([r for p in pairs for r in p.rows], dtype=np.float64)
    sizes = np.array([len(h) for p in pairs for h in p.hashed], dtype=np.int64)
    places = np.array([x for p in pairs for h in p.hashed for x in h], dtype=np.int64)
    return dense, places, np.repeat(1.0 / np.sqrt(np.maximum(sizes, 1)), sizes), np.concatenate([[0], np.cumsum(sizes)[:-1]])


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


class ClauseField:
    """A linear-chain conditional random field over dense and hashed clause features."""

    def __init__(self, width: int):
        self.w = np.zeros((width, len(TAGS)))
        self.h = np.zeros((HASHED, len(TAGS)))
        self.t = np.zeros((len(TAGS), len(TAGS)))
        self.speech: Speech | None = None

    def scores(self, laid: tuple) -> np.ndarray:
        dense, places, values, first = laid
        return dense @ self.w + np.add.reduceat(self.h[places] * values[:, None], first, axis=0)

    def _sums(self, e: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward sums of padded chains, the longest first, and their totals."""
        n, most, c = e.shape
        alive = live.sum(axis=0)
        f, b = np.zeros((n, most, c)), np.zeros((n, most, c))
        f[:, 0] = e[:, 0]
        for k in range(1, most):
            m = alive[k]
            f[:m, k] = _log_sum(f[:m, k - 1, :, None] + self.t[None], 1) + e[:m, k]
        for k in range(most - 2, -1, -1):
            m = alive[k + 1]
            b[:m, k] = _log_sum(self.t[None] + (e[:m, k + 1] + b[:m, k + 1])[:, None, :], 2)
        return f, b, _log_sum(f[np.arange(n), live.sum(axis=1) - 1], 1)

    @staticmethod
    def _pad(pairs: list[Pair]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(p.rows) for p in pairs])
        owner = np.repeat(np.arange(len(pairs)), lengths)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        live = np.zeros((len(pairs), int(lengths.max())), dtype=bool)
        live[owner, at] = True
        return owner, at, live

    def fit(self, pairs: list[Pair], tags: list[list[int]], steps: int = STEPS, decay: float = 1e-3, length: float = 1.0) -> ClauseField:
        """Full-batch ascent of the conditional likelihood; gradients by forward and backward sums over all chains at once."""
        n, c = len(pairs), len(TAGS)
        order = sorted(range(n), key=lambda i: -len(pairs[i].rows))
        pairs, tags = [pairs[i] for i in order], [tags[i] for i in order]
        laid = _lay_out(pairs)
        dense, places, values, first = laid
        owner, at, live = self._pad(pairs)
        clause = np.repeat(np.arange(len(owner)), np.diff(np.concatenate([first, [len(places)]])))
        hot = np.eye(c)[np.array([t for row in tags for t in row])]
        full = np.zeros((*live.shape, c))
        full[owner, at] = hot
        alive = live.sum(axis=0)
        seen_t = np.einsum("nta,ntb->ab", full[:, :-1], full[:, 1:])
        state = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in (("w", self.w), ("h", self.h), ("t", self.t))}
        e = np.zeros((*live.shape, c))
        for step in range(1, steps + 1):
            e[owner, at] = self.scores(laid)
            f, b, z = self._sums(e, live)
            wrong = hot - np.exp(f + b - z[:, None, None])[owner, at]
            gt = seen_t.copy()
            for k in range(1, live.shape[1]):
                m = alive[k]
                gt -= np.exp(f[:m, k - 1, :, None] + self.t[None] + (e[:m, k] + b[:m, k])[:, None, :] - z[:m, None, None]).sum(axis=0)
            gh = np.stack([np.bincount(places, weights=values * wrong[clause, k], minlength=HASHED) for k in range(c)], axis=1)
            for name, g, pace in (("w", dense.T @ wrong / n - decay * self.w, 0.25), ("h", gh / n - decay / 10 * self.h, 0.12), ("t", gt / n - decay * self.t, 0.25)):
                m, s = state[name]
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                v = getattr(self, name)
                v += length * pace * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
        return self

    def marginals(self, pairs: list[Pair]) -> list[np.ndarray]:
        """For each answer the chance of every tag at every clause."""
        order = sorted(range(len(pairs)), key=lambda i: -len(pairs[i].rows))
        ranked = [pairs[i] for i in order]
        owner, at, live = self._pad(ranked)
        e = np.zeros((*live.shape, len(TAGS)))
        e[owner, at] = self.scores(_lay_out(ranked))
        f, b, z = self._sums(e, live)
        p = np.exp(f + b - z[:, None, None])
        out: list[np.ndarray] = [np.empty(0)] * len(pairs)
        for k, i in enumerate(order):
            out[i] = p[k, : len(pairs[i].rows)]
        return out

    def tag(self, pairs: list[Pair]) -> list[list[int]]:
        """The most likely tags of each answer."""
        scores = self.scores(_lay_out(pairs)).tolist() if pairs else []
        t, every = self.t.T.tolist(), range(len(TAGS))
        out, at = [], 0
        for p in pairs:
            n = len(p.rows)
            best, back = scores[at], []
            for e in scores[at + 1 : at + n]:
                came = [max(every, key=lambda a, into=into: best[a] + into[a]) for into in t]
                best = [best[a] + t[b][a] + e[b] for b, a in enumerate(came)]
                back.append(came)
            tags = [max(every, key=best.__getitem__)]
            for came in reversed(back):
                tags.append(came[tags[-1]])
            out.append(tags[::-1])
            at += n
        return out


def coverage(pair: Pair, chances: np.ndarray) -> np.ndarray:
    """The share of an answer's words that is expected under each tag."""
    size = np.array([len(w) for w in pair.words], dtype=float)
    return size @ chances / max(1.0, size.sum())


def defect(pair: Pair, chances: np.ndarray) -> str | None:
    """What the tags' coverage of an answer's words amounts to."""
    if chances[-1, UNFINISHED] >= UNFINISHED_CHANCE:
        return "truncated"
    share = coverage(pair, chances)
    if share[REFUSAL] >= (REFUSAL_SHARE if sum(map(len, pair.words)) >= FEW_WORDS else 0.5):
        return "refusal"
    # An answer that repeats the question first ends otherwise.
    if share[ECHO] >= 0.6 or (share[ECHO] >= 0.45 and chances[-1, ECHO] >= 0.5):
        return "copy"
    if share[FOREIGN] >= 0.6:
        return "language"
    return None


def make_training(pairs: list[tuple[str | None, str, int, int, int]], speech: Speech, seed: int = 3) -> tuple[list[Pair], list[list[int]], list[tuple[int, float]]]:
    """Tagged answers, sound ones and defects made from them; those the corpus gave as they are, with the share of their words that questions use."""
    rng = np.random.default_rng(seed)
    given = [(Pair(*p, speech), p) for p in pairs if p[0] and p[1] and not is_empty(p[1])]
    given = [(x, p) for x, p in given if x.clauses]
    overlap = [sum(r[2] * len(w) for r, w in zip(x.rows, x.words)) / max(1, sum(map(len, x.words))) for x, _ in given]
    short = [g for g, o in zip(given, overlap) if sum(map(len, g[0].words)) <= 6 and not g[0].ended and not g[0].marked and g[1][2] <= 1 and o < 0.7]
    lists = [(x, p) for x, p in given if not x.ended and x.listed and x.closing > 0]
    sound = [g for g, o in zip(given, overlap) if g[0].ended and not g[0].marked and o < 0.7 and not g[0].strange and len(g[0].asked) > 2]
    made: list[Pair] = []
    tags: list[list[int]] = []

    def add(x: Pair, t: list[int]) -> None:
        for at in range(0, len(x.rows), TRAIN_CLAUSES):
            part = object.__new__(Pair)
            part.__dict__.update(x.__dict__, rows=x.rows[at : at + TRAIN_CLAUSES], hashed=x.hashed[at : at + TRAIN_CLAUSES], words=x.words[at : at + TRAIN_CLAUSES])
            made.append(part)
            tags.append(t[at : at + TRAIN_CLAUSES])

    def make(q: str | None, a: str, tag: int, places: int = 50, closing: int = 10, openings: int = 1, last: int | None = None, first: tuple[int, int] | None = None, kept: float = 1.0) -> None:
        x = Pair(q, a, openings, places, closing, speech)
        if kept < 1:  # the field must not lean on whole phrases
            x.hashed = [[0, *(v for v in h[1:] if rng.random() < kept)] for h in x.hashed]
        if x.clauses:
            t = [tag] * len(x.clauses)
            if first:
                t[: first[0]] = [first[1]] * min(first[0], len(t))
            if last is not None:
                t[-1] = last
            add(x, t)

    own: list[tuple[int, float]] = []
    for x, _ in [*sound, *short, *lists]:
        own.append((len(made), 2.0 if not x.ended else sum(w in speech.asked for c in x.words for w in c) / max(1, sum(map(len, x.words)))))
        add(x, [ANSWER] * len(x.rows))
    stands, closes = speech.stands, speech.closes
    # Lists are few but all alike: each is learnt from several times, whole and cut short.
    for x, p in lists:
        for _ in range(3):
            add(x, [ANSWER] * len(x.rows))
        keep = x.answer[: len(x.answer) - int(rng.integers(2, 9))].rstrip()
        last = PLACE.findall(keep.lower())[-1:]
        make(p[0], keep, ANSWER, stands[last[0]] if last else 0, closes[last[0]] if last else 0, p[2], UNFINISHED)
    speakers: dict[str, list[str]] = {}
    for x, p in sound:
        lang = speech.of(x.asked)[0]
        if lang:
            speakers.setdefault(lang, []).append(p[1])
    for i, (x, p) in enumerate(sound):
        q, a, openings = p[0], x.answer, p[2]
        lang = speech.of(x.asked)[0] or "pt"
        about = " ".join(q.rstrip("?").split()[-int(rng.integers(3, 6)) :])
        if i % 2 == 0:
            at = int(rng.integers(max(4, len(a) // 8), max(5, len(a) - 3)))
            comma = a.find(",", at) + 1 if rng.random() < 0.15 else 0
            keep = a[: comma or at].rstrip()
            last = PLACE.findall(keep.lower())[-1:]
            places, closing = (stands[last[0]], closes[last[0]]) if last else (0, 0)
            if not ENDED.search(keep):
                mark = ["", "", "", "...", "…", " [...]"][rng.integers(6)]
                make(q, keep + mark, ANSWER, places, closing, max(2, openings), UNFINISHED)
        elif i % 4 == 1:
            text = [q, q, q.lower(), q.upper(), fold(q), q.rstrip("?"), f"“{q.rstrip('?')}”"][rng.integers(7)]
            before, after = courtesy(lang, rng)
            make(q, before + text + after, ECHO)
            make(q, q + " " + a, ANSWER, 50, 10, openings, first=(len(CLAUSE.split(q)), ECHO))
            if rng.random() < 0.3:
                make(q, before + a, ANSWER, 50, 10, openings)
        else:
            others = [k for k in speakers if k != lang]
            if others:
                k = others[rng.integers(len(others))]
                make(q, speakers[k][rng.integers(len(speakers[k]))], FOREIGN, openings=5)
        # A refusal may come in any language; sound answers of the same words keep it from denials.
        k = lang if rng.random() < 0.6 else list(PATTERNS)[rng.integers(len(PATTERNS))]
        make(q, refusal(k, about, rng), REFUSAL, openings=int(rng.integers(1, 30)), kept=KEPT)
        if i % 2:
            make(q, assertion(lang, about, rng), ANSWER, kept=KEPT_SOUND)
    return made, tags, own


def places_in(answers: Iterable[str]) -> tuple[Counter, Counter]:
    """How often each word stands in answers and how often it closes a clause, for the last words of answers cut short here."""
    stands, closes = Counter(), Counter()
    for answer in answers:
        low = answer.strip(BLANKS).lower()
        for m in PLACE.finditer(low, 0, len(low)):
            stands[m.group()] += 1
            closes[m.group()] += low[m.end() : m.end() + 1] in tuple(".;,:!?|")
    return stands, closes


def _doubtful(own: list[tuple[int, float]]) -> set[int]:
    middle = float(np.median([share for _, share in own])) if own else 0.0
    return {i for i, share in own if share < middle} if len(own) >= 8 else set()


def _settle(trial: ClauseField, made: list[Pair], tags: list[list[int]], doubtful: set[int], drop: set[int]) -> None:
    """Tags the answers in doubt as a trial takes them; those it doubts are dropped."""
    order = sorted(doubtful)
    judged = [made[i] for i in order]
    for i, chances in zip(order, trial.marginals(judged) if judged else []):
        chance, found = coverage(made[i], chances)[REFUSAL], defect(made[i], chances)
        long = sum(map(len, made[i].words)) >= FEW_WORDS
        tags[i] = [REFUSAL if long and chance > REFUSAL_SHARE else ANSWER] * len(tags[i])
        if (chance > DOUBT and tags[i][0] == ANSWER) or found not in (None, "refusal"):
            drop.add(i)
        else:
            drop.discard(i)


def train(pairs: list[tuple[str | None, str, int, int, int]], speech: Speech | None = None) -> ClauseField | None:
    """A field fitted to pairs of (question, answer, openings, places, closing); None without a sound answer."""
    if speech is None:
        asked = [words(fold(p[0])) for p in pairs if p[0]]
        speech = Speech([*asked, *(words(fold(p[1])) for p in pairs if p[1])], asked)
        speech.stands, speech.closes = places_in(p[1] for p in pairs if p[0] and p[1] and not is_empty(p[1]))
    made, tags, own = make_training(pairs, speech)
    if not made:
        return None
    width = len(made[0].rows[0])
    drop: set[int] = set()
    doubtful = _doubtful(own)
    for _ in range(TRIALS if doubtful else 0):
        # Only answers taken for refusals so far are learnt from beside those not in doubt.
        learn = [i for i in range(len(made)) if i not in doubtful or tags[i][0] == REFUSAL]
        _settle(ClauseField(width).fit([made[i] for i in learn], [tags[i] for i in learn], TRIAL_STEPS), made, tags, doubtful, drop)
    keep = [i for i in range(len(made)) if i not in drop]
    field = ClauseField(width).fit([made[i] for i in keep], [tags[i] for i in keep])
    field.speech = speech
    return field


def train_further(first: ClauseField, pairs: list[tuple[str | None, str, int, int, int]], seed: int) -> tuple[ClauseField, int] | None:
    """The first field after some steps on other pairs, and how many chains it learnt from; None without a sound answer."""
    made, tags, own = make_training(pairs, first.speech, seed)
    if not made:
        return None
    drop: set[int] = set()
    _settle(first, made, tags, _doubtful(own), drop)
    keep = [i for i in range(len(made)) if i not in drop]
    if not keep:
        return None
    field = ClauseField(len(first.w))
    field.w, field.h, field.t = first.w.copy(), first.h.copy(), first.t.copy()
    return field.fit([made[i] for i in keep], [tags[i] for i in keep], NEXT_STEPS, length=NEXT_PACE), len(keep)


def _opening(c: Column) -> Column:
    return F.regexp_extract(c, r"^\s*(\S+\s+\S+)", 1)


def _last_word(c: Column) -> Column:
    """The last word in lower case, read backwards so that a long text costs no more than its length."""
    found = F.regexp_extract(F.reverse(F.regexp_replace(c, r"[\s ​﻿]+$", "")), r"^[^\p{L}\p{M}\p{N}]*([\p{L}\p{M}\p{N}-]+)", 1)
    return word_key(F.lower(F.reverse(found)))


def prepare(rows: DataFrame, key: str, question: str, answer: str, time: str) -> DataFrame:
    """Columns (key, question, answer, openings, places, closing): the latest delivery of each key with the corpus counts.

    Counts meet keys without their texts, blank openings and words each under a key of their own; the
    texts join once, by key.
    """
    picked = rows.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.struct(F.col(time).alias("at"), F.col(question).cast("string").alias("question"), F.col(answer).cast("string").alias("answer")).alias("r"))
    pairs = picked.groupBy("key").agg(F.max("r").alias("r")).select("key", "r.question", "r.answer")
    small = pairs.select("key", F.xxhash64("answer").alias("h"), F.xxhash64(F.nullif(_opening(F.col("answer")), F.lit(""))).alias("opening"), _last_word(F.col("answer")).alias("word"), (F.length(_opening(F.col("answer"))) > 0).alias("opens"))
    openings = small.filter("opens").select("opening", "h").distinct().groupBy("opening").agg(F.count("*").alias("openings"))
    ends = closing_words(pairs, "answer")
    alone = F.concat(F.lit("\x00"), F.pmod(F.xxhash64("key"), F.lit(100_000)).cast("string"))
    marked = small.select("key", F.when(F.col("opens"), F.col("opening")).otherwise(F.xxhash64("key")).alias("opening"), F.when(F.col("word") != "", F.col("word")).otherwise(alone).alias("word"))
    counts = marked.join(openings, "opening", "left").join(ends, "word", "left").select(F.col("key").alias("k"), *[F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in ("openings", "places", "closing")])
    return pairs.join(counts, pairs["key"] == counts["k"]).select("key", "question", "answer", "openings", "places", "closing")


def speech_of(prepared: DataFrame, n: int, rounds: int = 2) -> Speech:
    """Speech learnt from all n pairs, counts held to those of SHARD_PAIRS pairs."""
    speech, scale = Speech([], []), max(1.0, n / SHARD_PAIRS)
    sc = prepared.sparkSession.sparkContext
    columns = "kind string, word string, a double, b double, c double"
    for k in range(rounds):
        shared = sc.broadcast(speech)

        def count(batches: Iterator[pa.RecordBatch], shared=shared, first=k == 0) -> Iterator[pa.RecordBatch]:
            asked, stands, closes = Counter(), Counter(), Counter()
            spoken: dict[str, list[float]] = {}
            for batch in batches:
                rows = list(zip(*(c.to_pylist() for c in batch.columns)))
                questions = [words(fold(q)) for q, _ in rows if q]
                for w, v in shared.value.count([*questions, *(words(fold(a)) for _, a in rows if a)]).items():
                    spoken[w] = [x + y for x, y in zip(spoken[w], v)] if w in spoken else v
                if first:
                    asked.update(w for q in questions for w in q)
                    some = places_in(a for q, a in rows if q and a and not is_empty(a))
                    stands.update(some[0])
                    closes.update(some[1])
            out = [("spoken", w, *v) for w, v in spoken.items()] + [("asked", w, float(v), 0.0, 0.0) for w, v in asked.items()] + [("place", w, float(v), float(closes[w]), 0.0) for w, v in stands.items()]
            for at in range(0, len(out), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out[at : at + 10_000])], names=["kind", "word", "a", "b", "c"])

        rows = prepared.select("question", "answer").mapInArrow(count, columns).groupBy("kind", "word").agg(*[F.sum(c).alias(c) for c in "abc"])
        found = rows.filter(F.when(F.col("kind") == "asked", F.col("a") >= scale).otherwise(True)).toArrow().to_pydict()
        told = list(zip(*(found[c] for c in ("kind", "word", "a", "b", "c"))))
        speech.learn({w: [a / scale, b / scale, c / scale] for kind, w, a, b, c in sorted(told) if kind == "spoken"})
        if k == 0:
            speech.asked = {r[1] for r in told if r[0] == "asked"}
            speech.stands = Counter({r[1]: int(r[2]) for r in told if r[0] == "place"})
            speech.closes = Counter({r[1]: int(r[3]) for r in told if r[0] == "place"})
    return speech


def train_on(prepared: DataFrame) -> ClauseField | None:
    """A field that all pairs have taught: see above."""
    rows = prepared.filter("answer IS NOT NULL")
    n = rows.count()
    shards = max(1, round(n / SHARD_PAIRS))
    sharded = rows.select(F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), F.xxhash64("key").alias("h"), F.col("key").cast("string").alias("k"), "question", "answer", "openings", "places", "closing")
    speech = speech_of(rows, n)
    first, start = None, 0
    while first is None and start < shards:
        own = sharded.filter(F.col("shard") == start).orderBy("h", "k").collect()
        first, start = train([tuple(r)[3:] for r in own], speech), start + 1
    if first is None or shards == 1:
        return first
    shared = prepared.sparkSession.sparkContext.broadcast(first)
    shapes = [first.w.shape, first.h.shape, first.t.shape]

    def go_on(key: tuple, table: pa.Table) -> pa.Table:
        pairs = list(zip(*(table.column(c).to_pylist() for c in ("h", "k", "question", "answer", "openings", "places", "closing"))))
        got = train_further(shared.value, [p[2:] for p in sorted(pairs, key=lambda p: p[:2])], 3 + key[0].as_py())
        if got is None:
            return pa.table({"learnt": pa.array([], pa.int64()), "moved": pa.array([], pa.binary())})
        field, learnt = got
        moved = np.concatenate([(getattr(field, x) - getattr(shared.value, x)).ravel() for x in "wht"])
        return pa.table({"learnt": pa.array([learnt], pa.int64()), "moved": pa.array([moved.astype(np.float32).tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = 0, 0.0
        for batch in batches:
            for learnt, moved in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total, sums = total + learnt, sums + learnt * np.frombuffer(moved, dtype=np.float32).astype(np.float64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([sums.tobytes()], pa.binary())], names=["learnt", "moved"])

    # One sum a task comes to the driver.
    sums = sharded.groupBy("shard").applyInArrow(go_on, "learnt bigint, moved binary").mapInArrow(add, "learnt bigint, moved binary")
    total, moved = 0, np.zeros(sum(int(np.prod(x)) for x in shapes))
    for r in sums.toLocalIterator():
        total, moved = total + r.learnt, moved + np.frombuffer(bytes(r.moved))
    at = 0
    for name, shape in zip("wht", shapes):
        size = int(np.prod(shape))
        setattr(first, name, getattr(first, name) + moved[at : at + size].reshape(shape) / max(1, total))
        at += size
    return first


def judge(field: ClauseField | None, rows: list[tuple]) -> list[str | None]:
    """The defect, if any, of each (question, answer, openings, places, closing)."""
    out: list[str | None] = ["empty" if is_empty(r[1]) else None for r in rows]
    if field is None:
        return out
    live = [(i, Pair(*r, field.speech)) for i, r in enumerate(rows) if out[i] is None]
    for i, p in live:
        if not p.clauses:
            out[i] = "empty"
    live = [(i, p) for i, p in live if p.clauses]
    if live:
        # Padded together with answers of like length.
        live.sort(key=lambda x: len(x[1].clauses))
        for at in range(0, len(live), 128):
            part = live[at : at + 128]
            for (i, p), chances in zip(part, field.marginals([p for _, p in part])):
                out[i] = defect(p, chances)
    return out


def defective_pairs(prepared: DataFrame, field: ClauseField | None) -> DataFrame:
    """Columns (key, defect) of each defective pair."""
    shared = prepared.sparkSession.sparkContext.broadcast(field)
    kind = prepared.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(start, SLICE_ROWS)
                found = judge(shared.value, list(zip(*(batch.column(k).to_pylist() for k in range(1, 6)))))
                at = [i for i, d in enumerate(found) if d]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, type=pa.int64())), pa.array([found[i] for i in at], type=pa.string())], names=["key", "defect"])

    return prepared.mapInArrow(run, f"key {kind}, defect string")
