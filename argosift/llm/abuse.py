"""Abusive, hateful and sexual remarks: a lexicon searched with Levenshtein automata, weighed by context.

Every distinct token is brought to bare letters and intersected with a trie of the lexicon: the states of a Levenshtein automaton (with
swapped neighbours as one edit) walk down the trie, so that all terms within the allowed distance are found at once. Masked letters (``c**k``) match
any letter at no cost, letters drawn out are shortened, letters set apart are joined. A token that is an ordinary word (a whole word of
the public tokenizer's vocabulary) is never taken for a misspelling of another. Results are kept by token, so a token is searched once in a task.

A sentence with terms is then scored from the classes of terms in it and how near they stand to one another: who is addressed, which group
is named, what is wished, and whether the sentence quotes, reports or forbids such remarks instead of making one. The weights are a
logistic model, fitted on the labelled sentences of :mod:`argosift.llm.lexicon`, which are no part of any corpus.

Distribution: one pass over the documents, without shuffle; the lexicon and the weights go to the tasks in the closure (some tens of kilobytes).
"""

from __future__ import annotations

import base64
import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argosift.llm import lexicon
from argosift.llm.packing import tokenizer_path
from argosift.llm.textforms import bare_word, plain

_BITS = {name: 1 << i for i, name in enumerate(lexicon.CLASSES)}
#: Tokens that begin a run of words (an idiom, a threat, a kind of people).
_RUN = 1 << len(lexicon.CLASSES)
#: Classes that make a sentence worth a score.
_LEXICAL = sum(_BITS[c] for c in (*lexicon.FUZZY, "animal", "tender", "violent", "harm", "group", "track"))
#: Two letters set apart.
_SPACED = re.compile(r"(?<!\S)[^\W\d_]\s+[^\W\d_](?!\S)")
_STRETCH = re.compile(r"(.)\1{2,}")
_MASKS = frozenset("*#@$%!&?")
_LEET = str.maketrans("013457@$", "oieastas")
_END = re.compile(r"[.!?…]['\")\]»”]*$")
_QUOTE = "\"“”„«»"


class Hit(NamedTuple):
    term: str
    flags: int
    distance: int


class Trie:
    """A lexicon as nested dictionaries; under the key '' the terms' flags."""

    def __init__(self, terms: dict[str, int]):
        self.root: dict = {}
        for term, flags in terms.items():
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = (term, flags)

    def search(self, word: str, most: int) -> Hit | None:
        """The nearest term within ``most`` edits (insertion, deletion, substitution, swap of neighbours; masks match any letter), the first in
        order of the alphabet among equals."""
        best: Hit | None = None
        start = tuple(range(len(word) + 1))
        stack = [(self.root, start, None, "")]
        while stack:
            node, row, older, last = stack.pop()
            if "" in node and row[-1] <= most:
                term, flags = node[""]
                if best is None or (row[-1], term) < (best.distance, best.term):
                    best = Hit(term, flags, row[-1])
            for c, child in node.items():
                if not c:
                    continue
                new = [row[0] + 1]
                for i, w in enumerate(word):
                    cost = min(new[-1] + 1, row[i + 1] + 1, row[i] + (w != c and w not in _MASKS))
                    if older is not None and i and w == last and word[i - 1] == c:
                        cost = min(cost, older[i - 1] + 1)
                    new.append(cost)
                if min(new) <= most or min(row) < most:
                    stack.append((child, tuple(new), row, c))
        return best


@lru_cache(maxsize=2)
def ordinary_words(path: str) -> frozenset[str]:
    """Words that are one token of a public vocabulary when they follow a space."""
    with open(path, "rb") as lines:
        tokens = (base64.b64decode(line.split()[0]) for line in lines if line.strip())
        return frozenset(t[1:].decode().lower() for t in tokens if t[:1] == b" " and t[1:].isalpha() and len(t) > 4)


class Token(NamedTuple):
    """What is known of a token: its classes, its bare word, the term it stands for and at which distance, quote marks, whether it ends a sentence."""

    flags: int
    word: str
    term: str
    distance: int
    marks: int
    ends: bool


class Terms:
    """A lexicon of ``(term, class, misspellings too)`` and what is found in it for a token."""

    def __init__(self, rows: Iterable[tuple[str, str, bool]], vocabulary: str):
        self.exact: dict[str, int] = {}
        fuzzy: dict[str, int] = {}
        for term, kind, misspelt in rows:
            word = bare_word(term)
            if kind not in _BITS:
                raise ValueError(f"no class of terms is called {kind!r}")
            self.exact[word] = self.exact.get(word, 0) | _BITS[kind]
            if misspelt:
                fuzzy[word] = fuzzy.get(word, 0) | _BITS[kind]
        self.fuzzy, self.trie, self.vocabulary = fuzzy, Trie(fuzzy), vocabulary
        self.by_letter = {c: Trie({t: x for t, x in fuzzy.items() if t[0] == c}) for c in {t[0] for t in fuzzy if t}}
        self.every = Trie({t: flags for t, flags in self.exact.items() if flags & _LEXICAL and len(t) > 3})  # for masked letters
        self.known: dict[str, Token] = {}

    def __call__(self, raw: str) -> Token:
        """What a token is; the term is that of a misspelling or of a class searched with them."""
        found = self.known.get(raw)
        if found is None:
            if len(self.known) >= 300_000:
                self.known.clear()
            flags, word, term, distance = self._search(raw)
            ends = raw[-1] in ".!?…\"')]»”" and len(raw) > 1 and _END.search(raw) is not None
            marks = sum(raw.count(q) for q in _QUOTE)
            found = self.known[raw] = Token(flags | _RUN * (word in _RUN_STARTS), word, term, distance, marks, ends)
        return found

    def _plain_term(self, word: str, shown: str):
        return self.exact[word], shown, word if word in self.fuzzy else "", 0

    def _search(self, raw: str) -> tuple[int, str, str, int]:
        word = bare_word(raw)
        if word in self.exact:
            return self._plain_term(word, word)
        core = raw.strip(".,;:()[]{}\"'»«“”„…>~_")
        core = core.rstrip("!?") if not core.rstrip("!?").endswith(("*", "#")) else core
        core = core.strip("*") if core[:1] == core[-1:] == "*" else core  # emphasis, not a mask
        letters = sum(c.isalpha() for c in core)
        if not letters or len(word) < 3 and not any(c in _MASKS for c in core):
            return 0, word, "", 0
        if any(c in _MASKS for c in core[1:]):
            shape = "".join(c if c in _MASKS else bare_word(c).translate(_LEET) for c in core)
            if sum(c in _MASKS for c in shape) < len(shape) - 1:
                for trie in (self.trie, self.every):
                    hit = trie.search(shape, 0)
                    if hit:
                        return hit.flags, hit.term, hit.term if hit.term in self.fuzzy else "", 0
                plainer = bare_word(core.translate(_LEET))
                if plainer in self.exact:
                    return self._plain_term(plainer, plainer)
            return 0, word, "", 0
        forms = [word]
        if letters < len(core):
            forms.append(word.translate(_LEET))
        if _STRETCH.search(word):
            forms += [_STRETCH.sub(r"\1", word), _STRETCH.sub(r"\1\1", word)]
        for form in forms:
            if form in self.exact:
                return self._plain_term(form, form)
        best = None
        if word.isalpha() or len(forms) > 1:
            usual = ordinary_words(self.vocabulary)
            for form in forms:
                if len(form) < 4 or not form.isalpha() or form in usual or form in _NEIGHBOURS or (form.endswith("s") and form[:-1] in usual):
                    continue
                hit = self.by_letter[form[0]].search(form, 2 if len(form) >= 9 else 1) if form[0] in self.by_letter else None
                if hit and self._likely(form, hit) and (best is None or hit.distance < best.distance):
                    best = hit
        return (best.flags, best.term, best.term, best.distance) if best else (0, word, "", 0)

    @staticmethod
    def _likely(form: str, hit: Hit) -> bool:
        """Whether a near word is a misspelling: with its first letter; four letters only with letters swapped or doubled, two edits only in long terms."""
        term = hit.term
        if form[0] != term[0]:
            return False
        if len(term) < 5:
            return sorted(form) == sorted(term) or (len(form) == len(term) + 1 and set(form) == set(term))
        return hit.distance == 1 or len(term) >= 9

    def joined(self, raws: list[str]) -> list[str]:
        """Letters set apart by spaces as one token, where that makes a term searched with misspellings."""
        out, i = [], 0
        while i < len(raws):
            j = i
            while j < len(raws) and len(raws[j]) == 1 and raws[j].isalpha():
                j += 1
            k = i
            while k < j:
                for end in range(min(j + 1, k + 16, len(raws)), k + 2, -1):
                    if bare_word("".join(raws[k:end])) in self.fuzzy:
                        out.append("".join(raws[k:end]))
                        k = end
                        break
                else:
                    out.append(raws[k])
                    k += 1
            i = max(k, j)
            if i < len(raws) and k == j:
                out.append(raws[i])
                i += 1
        return out


def _runs_of(text: str) -> dict[str, list[tuple[str, ...]]]:
    runs: dict[str, list[tuple[str, ...]]] = {}
    for phrase in re.split(r"[|\n]+", text):
        words = tuple(phrase.split())
        if words:
            runs.setdefault(words[0], []).append(words)
    return runs


_IDIOMS, _KINDS, _THREATS = _runs_of(lexicon.IDIOMS), _runs_of(lexicon.KINDS), _runs_of(lexicon.THREATS)
_RUN_STARTS = frozenset((*_IDIOMS, *_KINDS, *_THREATS, "die"))
_BEFORE_DEATH = frozenset(lexicon.BEFORE_DEATH.split())
_NEIGHBOURS = frozenset(lexicon.NEIGHBOURS.split())
#: Words on either side of a term that a score looks at.
WINDOW = 12


def _places(words: list[str], runs) -> list[int]:
    return [i for i, w in enumerate(words) for run in runs.get(w, ()) if tuple(words[i : i + len(run)]) == run]


def _deaths(words: list[str]) -> list[int]:
    return [i for i, w in enumerate(words) if w == "die" and i and words[i - 1] in _BEFORE_DEATH] if "die" in words else []


def _near(a: list[int], b: list[int], reach: int) -> bool:
    return any(0 < abs(i - j) <= reach for i in a for j in b)


def _after(a: list[int], b: list[int], reach: int) -> bool:
    """Whether one of b follows one of a within reach."""
    return any(0 < j - i <= reach for i in a for j in b)


#: Words that lead to a thing as the object of a verb.
_THING_LEADS = frozenset("the a an this that it its old in at to from for with das den ein eine".split())

#: What is said of whom: the class of remark a feature speaks for.
_SPEAKS = {"insult": "abuse", "slur": "hate", "scorn": "abuse", "profane": "abuse", "animal": "abuse", "either": "abuse", "sex": "sexual", "tender": "sexual", "violent": "threat", "harm": "threat", "track": "threat", "group": "hate"}


def features(part: list[Token], quoted: list[bool]) -> dict[str, float]:
    """What the context model knows of a sentence: which classes stand in it and within which distance of each other."""
    at = {c: [] for c in _BITS}
    for i, token in enumerate(part):
        flags = token[0]
        if flags:
            for c, bit in _BITS.items():
                if flags & bit:
                    at[c].append(i)
    words = [t[1] for t in part]
    idiom, kind = _places(words, _IDIOMS), _places(words, _KINDS)
    at["harm"] += [i + 1 for i in _places(words, _THREATS)] + _deaths(words)
    you, person, work, tech = at["you"], at["person"], at["work"], at["technical"]
    group = at["group"] + kind + at["slur"]
    people = you + person + at["insult"]
    bodily = at["tender"]
    thing = len(set(work + tech))
    strong = at["insult"] + at["slur"] + at["sex"]
    hits = strong + at["animal"] + at["scorn"] + at["profane"] + at["violent"] + at["harm"] + bodily + group
    hurt = at["violent"] + at["harm"]
    at["animal"] += at["either"]
    close = [i for i in bodily if any(0 < abs(i - j) <= 6 and words[i] != words[j] for j in bodily)]
    soft = {words[i] for i in close}
    vile = [i for i in at["vile"] + at["animal"] + at["scorn"] if i not in at["group"]]
    f = {
        "insult": bool(at["insult"]), "insult you": _near(at["insult"], you, 6), "insult person": _near(at["insult"], person, 8), "insults": len(at["insult"]) > 1,
        "insult scorn": _near(at["insult"], at["scorn"] + at["profane"] + at["animal"], 3),
        "slur": bool(at["slur"]), "slur you": _near(at["slur"], you, 6),
        "animal": bool(at["animal"]), "animal you": _near(at["animal"], you, 6), "animal person": _near(at["animal"], person, 5), "animal scorn": _near(at["animal"], at["scorn"], 3),
        "scorn": bool(at["scorn"]), "scorn you": _near(at["scorn"], you, 3), "scorn person": _near(at["scorn"], person, 3), "scorn work": _near(at["scorn"], work, 4), "scorns": len(at["scorn"]) > 1,
        "profane": bool(at["profane"]), "profane you": _after(at["profane"], you, 2), "profane work": _near(at["profane"], work + tech, 3), "profane person": _near(at["profane"], person + you, 4),
        "idiom": bool(idiom), "idiom people": bool(idiom) and bool(people), "idiom lexical": bool(idiom) and bool(strong or at["animal"] or at["scorn"] or at["profane"]),
        "mind": _near(at["mind"], people + at["animal"], 8), "mind lexical": bool(at["mind"]) and bool(strong or at["animal"] or at["scorn"]),
        "sex": bool(at["sex"]), "sexes": len(at["sex"]) > 1, "sex tender": bool(at["sex"]) and bool(bodily), "sex offer": (bool(at["sex"]) or len(soft) > 1) and bool(at["offer"]),
        "tender": bool(bodily), "tenders": len(soft) > 1, "many tenders": len(soft) > 2, "tender person": _near(bodily, person + you, 5), "tender two person": len(soft) > 1 and bool(person + you),
        "tender my": any(words[i - 1] in ("my", "your", "her", "his") for i in bodily if i), "tender profane": bool(bodily) and bool(at["profane"]) and bool(you),
        "tender body": _near(bodily, at["body"], 5) and bool(people),
        "violent": bool(at["violent"]), "violent you": _after(at["violent"], you, 2), "violent body": _near(at["violent"], at["body"], 4) and bool(you), "violent intent": _after(at["intent"], at["violent"], 4) and bool(you),
        "violent person": _after(at["violent"], person, 3), "violent work": _after(at["violent"], work + tech, 4),
        "harm": bool(at["harm"]), "harm you": _near(at["harm"], you, 5), "harm intent": _near(at["harm"], at["intent"], 3) and bool(you), "harm wished": any(_after([i], [j], 2) and _after([j], hurt, 3) for i in at["intent"] for j in you), "harm bait": bool(at["harm"]) and bool(at["bait"]) and bool(you),
        "harm doing": any(w.endswith("ing") for i in at["harm"] for w in words[i + 1 : i + 2]), "hurt warn": bool(hurt) and bool(at["warn"]) and bool(you), "hurt home": bool(hurt) and bool(at["home"]) and bool(you), "hurts": len(set(hurt)) > 1 and bool(you),
        "hurt thing": any(w in _THING_LEADS for i in hurt for w in words[i + 1 : i + 2]), "hurt thing alone": any(w in _THING_LEADS for i in hurt for w in words[i + 1 : i + 2]) and not people,
        "track": _after(at["track"], you, 3), "track home": _near(at["track"], at["home"], 8) and bool(you), "track warn": _after(at["track"], you, 3) and bool(at["warn"]), "track hurt": _after(at["track"], you, 4) and bool(hurt),
        "group": bool(at["group"]), "kind": bool(kind), "group vile": _near(group, vile, 10), "group exclude": _near(group, at["exclude"], 8), "group excludes": len(at["exclude"]) > 1 and bool(group), "group insult": _near(group, at["insult"] + at["animal"], 8),
        "group hurt": _after(hurt, group, 4), "group wish": _near(group, at["exclude"] + at["violent"], 8) and bool(at["intent"]), "group of things": _after(at["group"], work + tech, 2),
        "group exclude vile": bool(group) and bool(at["exclude"]) and bool(vile),
        "report": bool(at["report"]), "reports": len(at["report"]) > 1, "report strong": bool(at["report"]) and bool(hits), "quoted": bool(hits) and any(quoted[i] for i in hits), "quoted report": bool(at["report"]) and any(quoted[i] for i in hits),
        "thing": thing > 0, "things": thing > 1, "many things": thing > 3, "thing strong": thing > 0 and not (strong or idiom), "no person": not people, "misspelt": any(part[i][3] for i in strong),
        "many hits": len(set(hits)) > 2,
    }
    return {k: float(v) for k, v in f.items()}


_NAMES = tuple(features([], []))


def fit_context(samples: list[tuple[object, int, str]], terms: Terms, penalty: float = 0.05) -> np.ndarray:
    """Weights (the last is the constant) of a logistic model on ``(template, label, sentence)``, by Newton steps with a quadratic penalty.

    Sentences of one template weigh the square root of their number together, so that often filled templates do not decide alone."""
    scorer = Scorer(terms, np.zeros(len(_NAMES) + 1))
    x = np.array([[*scorer.vector(s), 1.0] for _, _, s in samples])
    y = np.array([label for _, label, _ in samples], float)
    often = Counter(t for t, _, _ in samples)
    size = np.array([often[t] ** -0.5 for t, _, _ in samples])
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(len(w))
    ridge[-1, -1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (size * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (size * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Scorer:
    """Scores of documents."""

    def __init__(self, terms: Terms, weights: np.ndarray):
        self.terms, self.weights = terms, weights

    def sentences(self, text: str) -> Iterator[tuple[int, list[Token], list[bool]]]:
        """``(flags of all, tokens, whether each is in quotes)`` of every stretch up to a sentence end."""
        text = plain(text)
        raws = text.split()
        if _SPACED.search(text):
            raws = self.terms.joined(raws)
        known, token = self.terms.known, self.terms
        part, quoted, flags, open_ = [], [], 0, False
        for raw in raws:
            t = known.get(raw) or token(raw)
            part.append(t)
            flags |= t.flags
            if t.marks:
                quoted.append(True)
                open_ ^= t.marks % 2 == 1
            else:
                quoted.append(open_)
            if t.ends:
                yield flags, part, quoted
                part, quoted, flags, open_ = [], [], 0, False
        if part:
            yield flags, part, quoted

    def vector(self, sentence: str) -> list[float]:
        """Features of a text taken as one sentence."""
        parts = [(p, q) for _, p, q in self.sentences(sentence)]
        f = features([t for p, _ in parts for t in p], [x for _, q in parts for x in q])
        return [f[n] for n in _NAMES]

    def sentence(self, part, quoted) -> tuple[float, str, str]:
        """``(probability, kind, term)``: kind and term are those of the class that adds most."""
        f = features(part, quoted)
        values = np.array([*(f[n] for n in _NAMES), 1.0]) * self.weights
        weight = {}
        for n, v in zip(_NAMES, values, strict=False):
            kind = n.split()[0].rstrip("s")
            if kind in _SPEAKS and v:
                weight[kind] = weight.get(kind, 0.0) + float(v)
        top = max(weight, key=lambda k: (weight[k], k), default="")
        term = next((t[2] or t[1] for t in part if top and t[0] & _BITS[top]), "")
        return float(1 / (1 + np.exp(-values.sum()))), _SPEAKS.get(top, "abuse"), term

    @staticmethod
    def windows(flags: int, part) -> list[tuple[int, int]]:
        """The stretches of a sentence that are scored: ``WINDOW`` words on either side of each term or idiom; a short sentence is one."""
        if not flags & (_LEXICAL | _RUN):
            return []
        words = [t[1] for t in part]
        idioms = [i for runs in (_IDIOMS, _KINDS, _THREATS) for i in _places(words, runs)] + _deaths(words) if flags & _RUN else []
        if not idioms and not flags & _LEXICAL:
            return []
        if len(part) <= 2 * WINDOW:
            return [(0, len(part))]
        hits = [i for i, t in enumerate(part) if t[0] & _LEXICAL] + idioms
        return sorted({(max(0, i - WINDOW), min(len(part), i + WINDOW + 1)) for i in hits})

    def document(self, text: str, least: float) -> tuple[float, str, str, int, int]:
        """``(score, kind, term, distance, number of remarks)``; kind, term and distance are those of the highest sentence."""
        top, missed, remarks = (0.0, "", "", 0), 1.0, 0
        for flags, part, quoted in self.sentences(text):
            best = (0.0, "", "", 0)
            for low, high in self.windows(flags, part):
                near = part[low:high]
                score, kind, term = self.sentence(near, quoted[low:high])
                if score > best[0]:
                    best = (score, kind, term, next((t[3] for t in near if t[2] == term and t[3]), 0))
            if best[0] > top[0]:
                top = best
            if best[0] >= least:
                remarks += 1
                missed *= 1 - best[0]
        return max(top[0], 1 - missed), *top[1:], remarks


def default_scorer(terms=None, samples=None, vocabulary: str | None = None) -> Scorer:
    """A scorer of a lexicon and labelled sentences (:mod:`argosift.llm.lexicon` where none are given)."""
    found = Terms(terms if terms is not None else lexicon.default_terms(), vocabulary or tokenizer_path())
    if not os.path.exists(found.vocabulary):
        raise FileNotFoundError(f"no vocabulary of ordinary words at {found.vocabulary}")
    rows = samples if samples is not None else lexicon.labelled_sentences()
    return Scorer(found, fit_context(rows, found))


def score_documents(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", least: float = 0.5, terms: DataFrame | None = None,
    samples: DataFrame | None = None, most_samples: int = 100_000, vocabulary: str | None = None,
) -> DataFrame:
    """``(doc_id, source, score, kind, term, distance, remarks)`` for every row.

    score: 1 minus the product of the complements of the remarks (sentences of at least ``least``), or the highest sentence below that;
    0 for null and empty texts. A row with a null doc_id or source keeps the null. Equal scores: the first sentence gives kind and term.
    distance is the number of edits between the text's spelling and the term.

    ``terms (term, class, misspelt)`` and ``samples (label, sentence)`` replace the default lexicon and labelled sentences; of the samples at
    most ``most_samples``, by hash, are fitted.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text"))
    lexical = [(r[0], r[1], bool(r[2])) for r in terms.select("term", "class", "misspelt").collect()] if terms is not None else None  # a lexicon
    labelled = None
    if samples is not None:
        labelled = [(i, r[0], r[1]) for i, r in enumerate(samples.select("label", "sentence").orderBy(F.xxhash64("sentence"), "sentence").limit(most_samples).collect())]
    fitted = default_scorer(lexical, labelled, vocabulary)
    place, weights = fitted.terms.vocabulary, fitted.weights

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(Terms(lexical if lexical is not None else lexicon.default_terms(), place), weights)
        for pdf in batches:
            found = [scorer.document(t, least) if t else (0.0, "", "", 0, 0) for t in pdf["text"]]
            out = pd.DataFrame(found, columns=["score", "kind", "term", "distance", "remarks"])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy(dtype=object))
            out.insert(1, "source", pdf["source"].to_numpy(dtype=object))
            yield out

    return rows.mapInPandas(score, "doc_id long, source string, score double, kind string, term string, distance int, remarks int")


def rates_by_source(scores: DataFrame, least: float = 0.5) -> DataFrame:
    """``(source, n_docs, n_flagged, rate, mean_score)``; null is a source of its own."""
    flag = F.col("remarks") > 0
    return scores.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.count_if(flag).alias("n_flagged"), F.round(F.avg(flag.cast("double")), 6).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score")
    )
