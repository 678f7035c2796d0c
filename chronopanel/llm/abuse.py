"""Abusive, hateful or sexual language: Levenshtein automata over a lexicon trie, scored in context."""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.abuse_terms import CLASSES, COMMON, ORDINARY, RULES

VOWELS = frozenset("aeiou")
#: Characters that look like Latin letters (Cyrillic and Greek), and signs that stand for letters.
_LOOKALIKE = str.maketrans("аеосрхуіјѕкмтнвԁӏАЕОСРХУІЈЅКМТНВαοερικυντ", "aeocpxyijskmtnbdlAEOCPXYIJSKMTNBaoepikuvt")
_SIGNS = str.maketrans("013457+@$", "oieastta" + "s")
_INVISIBLE = re.compile("[­​-‏⁠-⁤﻿᠎]")
_FOREIGN = re.compile("[Ͱ-ϿЀ-ԯ]")
_BLOB = re.compile(r"[A-Za-z0-9+/]{60,}={0,2}")
_TOKEN = re.compile(r"[0-9+*@$]*[^\W\d_][\w+*@$\-]*")
_SIGNED = re.compile(r"[0-9+@$].*[^\W\d_]|[^\W\d_].*[0-9+@$]")
_SIGNED_TOKEN = re.compile(r"[\w+*@$\-]+")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")
_COUNTED = re.compile(r"\d+[^\W\d_]$")
_JOINT = re.compile(r"[_\-]+")
_VOWEL_RUN = re.compile(r"([aeiou])\1+")
_LONG_RUN = re.compile(r"(.)\1{2,}")
#: A single quoted word is a mention, unless it is a call's whole argument.
_MENTION = r"['\"‘“`«]{0}['\"’”`»]"
KINDS = ("insult", "threat", "hate", "sexual")


def _bare(word: str) -> str:
    """Lower case without accents, hyphens and underscores."""
    w = word.lower().replace("-", "").replace("_", "").replace("ß", "ss")
    if not w.isascii():
        w = "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c))
    return w


def fold(word: str) -> str:
    """Lower case without accents, runs of one vowel as one, hyphens and underscores gone."""
    return _LONG_RUN.sub(r"\1\1", _VOWEL_RUN.sub(r"\1", _bare(word)))


def plain(token: str) -> str:
    """A token as letters: signs that stand for letters are read as these."""
    t = token
    if any(c in "013457+@$" for c in t):
        t = t.translate(_SIGNS)
    return fold(t)


class Trie:
    """A trie of folded words; each node is (children, words that end here)."""

    def __init__(self, words: Iterator[str] | list[str]) -> None:
        self.root: tuple[dict, list[str]] = ({}, [])
        for word in words:
            node = self.root
            for c in word:
                node = node[0].setdefault(c, ({}, []))
            if word not in node[1]:
                node[1].append(word)


def budget(length: int) -> int:
    """Edit cost within which a word of so many letters is recognised."""
    return 0 if length <= 3 else 1 if length == 4 else 2 if length == 5 else 3 if length <= 7 else 4


def consonants(word: str) -> str:
    return "".join(x for x in word if x not in VOWELS)


def one_less(word: str) -> set[str]:
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


class Reach:
    """A test that no token within the automaton's cost fails, much cheaper than the automaton.

    It compares consonants. Of these a word loses one for 2 and two for 4; one
    is wrong or additional for 3. So the token's consonants are the word's, or
    the word's less one or two, or else word and token agree once the token
    leaves out one and the word at most one. Each is kept for the words whose
    budget pays for it, with the lengths of these words: a token has at most one
    letter more, and at most four less.
    """

    def __init__(self, words: Iterator[str] | list[str]) -> None:
        self.less: dict[str, int] = {}
        self.swap: dict[str, int] = {}
        for w in words:
            most, c, bit = budget(len(w)), consonants(w), 1 << len(w)
            near = one_less(c)
            lost = {c} | (near if most >= 2 else set()) | ({x for y in near for x in one_less(y)} if most >= 4 else set())
            if len(w) > 3:
                for x in lost:
                    self.less[x] = self.less.get(x, 0) | bit
                for x in {c} | near if most >= 3 else ():
                    self.swap[x] = self.swap.get(x, 0) | bit

    def may(self, token: str) -> bool:
        c, n = consonants(token), len(token)
        lengths = 63 << (n - 1)
        if self.less.get(c, 0) & lengths:
            return True
        # a token of five letters or fewer has no budget for a wrong letter
        return n > 5 and any(self.swap.get(x, 0) & lengths for x in one_less(c))


class LevenshteinAutomaton:
    """The weighted Levenshtein automaton of one token, intersected with a trie.

    A state is the row of costs of having read the trie's path against every
    prefix of the token. Losing a vowel costs 1, losing another letter 2, a
    wrong or additional letter 3, a vowel for a consonant or the reverse 4; a star is any vowel for 0, any letter for 1,
    and costs 1 where it stands for none (one of a run of vowels). Letters in
    `free` are lost for nothing.
    """

    def __init__(self, token: str, most: int, free: frozenset[str] = frozenset()) -> None:
        self.token, self.most, self.free = token, most, free

    def start(self) -> tuple[int, ...]:
        out = [0]
        for t in self.token:
            out.append(out[-1] + (1 if t == "*" else 3))
        return tuple(out)

    def step(self, row: tuple[int, ...], c: str) -> tuple[int, ...]:
        lost = 0 if c in self.free else 1 if c in VOWELS else 2
        out = [row[0] + lost]
        for j, t in enumerate(self.token, 1):
            if t == c:
                swap = 0
            elif t == "*":
                swap = 0 if c in VOWELS else 1
            else:
                swap = 3 if (c in VOWELS) == (t in VOWELS) else 4
            out.append(min(row[j - 1] + swap, row[j] + lost, out[j - 1] + (1 if t == "*" else 3)))
        return tuple(out)

    def intersect(self, trie: Trie) -> list[str]:
        """All words of the trie that the automaton accepts within their budget."""
        found = []
        stack = [(trie.root, self.start())]
        while stack:
            (children, words), row = stack.pop()
            for w in words:
                if row[-1] <= min(self.most, budget(len(w))):
                    found.append(w)
            for c, child in children.items():
                nxt = self.step(row, c)
                if min(nxt) <= self.most:
                    stack.append((child, nxt))
        return found


class AbuseScorer:
    """Scores texts; holds the lexicon, the compiled rules and a cache of tokens."""

    CACHE = 400_000
    #: Signs that an identifier cannot hold: letters they stood for are missing in it.
    UNSIGNED = frozenset("tas")

    def __init__(self) -> None:
        labels: dict[str, set[str]] = {}
        forms: dict[str, str] = {}

        def entry(word: str) -> set[str]:
            w = fold(word)
            forms[w] = forms[_bare(word)] = w
            return labels.setdefault(w, set())

        for name, words in CLASSES.items():
            for w in words.split():
                entry(w).add("@" + name)
        self.rules: list[tuple[float, int, list[frozenset[str]], str]] = []
        for weight, step, pattern, kind in RULES:
            slots = []
            for part in pattern.split():
                slot = frozenset(x if x[0] == "@" else fold(x) for x in part.split("|"))
                slots.append(slot)
                for x in part.split("|"):
                    if x[0] != "@":
                        entry(x)
            self.rules.append((weight, step, slots, kind))
        self.labels = {w: frozenset({w, *c}) for w, c in labels.items()}
        # Short slurs are one letter from ordinary words: these are read as they stand.
        self.trie = Trie(sorted(w for w, x in self.labels.items() if len(w) > 6 or "@SLUR" not in x))
        self.reach = Reach(sorted(self.labels))
        self.ordinary = frozenset(fold(w) for w in ORDINARY)
        self.common = frozenset(fold(w) for w in COMMON)
        # Words run together are told apart by one pass over them.
        for w in COMMON:
            forms.setdefault(_bare(w), fold(w))
        self.run_on = ahocorasick.Automaton()
        for form, w in forms.items():
            if len(form) > 1:
                self.run_on.add_word(form, (len(form), w, len(form) > 3 and w in self.labels and w not in self.common))
        self.run_on.make_automaton()
        self.by_slot: dict[str, list[int]] = {}
        for n, (_, _, slots, _) in enumerate(self.rules):
            for x in slots[-1]:
                self.by_slot.setdefault(x, []).append(n)
        self.cache: dict[object, tuple | None] = {}

    def read(self, token: str, signed: bool = False) -> tuple | None:
        """What a token may mean: a tuple of (labels, is a trigger) per word in it, None if nothing."""
        out = self._words(token, signed)
        out = out if any(x[0] for x in out) else None
        if len(self.cache) >= self.CACHE:
            self.cache.clear()
        self.cache[(token, True) if signed else token] = out
        return out

    def read_cached(self, token: str, signed: bool = False) -> tuple | None:
        key = (token, True) if signed else token
        return self.cache[key] if key in self.cache else self.read(token, signed)

    def _words(self, token: str, signed: bool) -> tuple:
        parts = [p for p in _JOINT.split(token) if p] if "_" in token or "-" in token else [token]
        if len(parts) < 2:
            return self._part(parts[0], signed) if parts else ()
        whole = plain(token)
        if whole in self.labels and whole not in self.common:
            return ((self.labels[whole], True),)
        if "_" not in token:
            out = self._part(token, signed)
            if any(x[1] for x in out):
                return out
        merged: list[str] = []
        out: tuple | list
        for p in parts:  # a word spelled with separators between the letters
            if len(p) == 1 and merged and (len(merged[-1]) == 1 or merged[-1][0] == "\0"):
                merged[-1] = "\0" + merged[-1].lstrip("\0") + p
            else:
                merged.append(p)
        out = []
        for p in merged:
            if p.isdigit():  # a number between others, not letters in disguise
                out.append((frozenset(), False))
            elif p[0] != "\0":
                out += self._part(p, signed)
            elif len(p) > 4:
                out += self._part(p[1:], signed)
            else:
                for c in p[1:]:
                    out += self._part(c, signed)
        return tuple(out)

    def _part(self, part: str, signed: bool = False) -> tuple:
        w = plain(part)
        if not signed and _COUNTED.match(part):
            return ((frozenset(), False),)
        if w in self.labels:
            return ((self.labels[w], w not in self.common),)
        if len(w) > 1 and w[0] == w[-1] == "*":  # emphasis, not letters left out
            return self._part(part.strip("*"), signed) if part.strip("*") else ((frozenset(), False),)
        if len(w) < (2 if signed else 3) or w in self.ordinary:
            return ((frozenset(), False),)
        words: list[str] = []
        if len(w) <= 24:
            if signed:
                words = LevenshteinAutomaton(w, min(4, max(1, len(w) // 2)), self.UNSIGNED).intersect(self.trie)
            elif "*" in w or self.reach.may(w):
                words = LevenshteinAutomaton(w, min(4, max(1, len(w) // 2))).intersect(self.trie)
            words = [x for x in words if len(x) > (2 if signed else 3) or "*" in w]
        if words:
            return ((frozenset().union(*(self.labels[x] for x in words)), any(x not in self.common for x in words)),)
        if len(w) >= 8:
            for c in self._chains(_bare(part.translate(_SIGNS)), 8):
                if len(w) <= 24 and not c[0]:
                    continue
                return tuple((self.labels.get(x, frozenset()), x in self.labels and x not in self.common) for x in c[1])
        return ((frozenset(), False),)

    def _chains(self, w: str, least: int) -> list[tuple[bool, list[str]]]:
        """Stretches of w that are words run together and hold a telling one: (is it all of w, words).

        One pass finds every known word; a stretch is continued from the words
        that end where the next begins, or one letter before (an article).
        Within a longer text a stretch must have 12 letters or more, so that
        random letters give none.
        """
        ends: dict[int, tuple[int, bool, int, str]] = {}
        for at, (n, word, tells) in self.run_on.iter(w):
            start, end = at + 1 - n, at + 1
            prev = ends.get(start)
            if prev is None and start and w[start - 1] in "aiu":
                prev, start = ends.get(start - 1), start - 1
                if prev is None:
                    start += 1
            new = (end - start + (prev[0] if prev else 0), tells or bool(prev and prev[1]), start if prev else -1, word)
            if end not in ends or new[:2] > ends[end][:2]:
                ends[end] = new
        out, limit = [], len(w) + 1
        for end in sorted(ends, reverse=True):
            covered, tells, _, _ = ends[end]
            if end > limit or not tells or covered < (least if covered == len(w) else 12):
                continue
            words, at = [], end
            while at in ends:
                words.append(ends[at][3])
                if ends[at][2] < 0:
                    break
                at = ends[at][2]
            limit = end - covered
            out.append((covered == len(w), words[::-1]))
        return out

    def _unblob(self, m: re.Match) -> str:
        """Encoded data as a space; words run together within it as words."""
        got = self._chains(_bare(m[0].translate(_SIGNS)), 12)
        return " ".join(["", *(x for _, c in reversed(got) for x in c), ""]) if got else " "

    def lines(self, text: str) -> list[str]:
        """The cells of a text as lines, with escapes, look-alikes and invisible signs undone."""
        if text.lstrip().startswith(("{", "[")):
            try:
                text = "\n".join(_strings(json.loads(text)))
            except (ValueError, RecursionError):
                pass
        if "\\n" in text or "\\u" in text:
            text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)), text.replace("\\n", "\n")).replace('\\"', '"')
        if not text.isascii():
            text = _INVISIBLE.sub("", text)
            if _FOREIGN.search(text):
                text = text.translate(_LOOKALIKE)
        return _BLOB.sub(self._unblob, text).split("\n")

    def score(self, text: str) -> tuple[dict[str, float], int]:
        """Evidence of each kind in a text, and the number of lines that hold any."""
        total, hits = dict.fromkeys(KINDS, 0.0), 0
        cache = self.cache
        lines = self.lines(text)
        for k, line in enumerate(lines):
            tokens = _TOKEN.findall(line)
            if not tokens:
                continue
            loud = False
            for t in tokens:
                r = cache[t] if t in cache else self.read(t)
                if r is not None and any(x[1] for x in r):
                    loud = True
                    break
            spelled = not loud and sum(len(t) == 1 for t in tokens) >= 3
            if not loud and not spelled:
                continue
            if len(tokens) == 1 and len(cache[tokens[0]] or ()) < 2 and self._listed(lines, k):
                continue
            found = self.judge(line, tokens)
            if any(found.values()):
                hits += 1
                for kind, v in found.items():
                    total[kind] += v
        return total, hits

    def _listed(self, lines: list[str], k: int) -> bool:
        """Is a line of one word an entry of a list of words, or beside talk of such words?"""
        for near in lines[max(0, k - 2) : k] + lines[k + 1 : k + 3]:
            words = _TOKEN.findall(near)
            if len(words) == 1 and len(near.split()) <= 2 or any("@META" in x[0] for t in words for x in self.read_cached(t) or ()):
                return True
        return False

    def judge(self, line: str, tokens: list[str]) -> dict[str, float]:
        """Evidence in one line: rules met by its words, less in a context of quotation."""
        signed = False
        if any(_SIGNED.search(t) for t in tokens):
            # an identifier counts as the words in it
            heard = sum(bool(_SIGNED.search(p)) and bool(self.read_cached(p)) for t in tokens for p in t.split("_"))
            if heard >= 2:
                signed = True
                tokens = _SIGNED_TOKEN.findall(line)  # words all of signs, too: 455, +0
        words: list[frozenset[str]] = []
        single: list[str] = []
        last = ""

        def spell() -> None:
            whole = "".join(single)
            if len(single) >= 4 and self.read_cached(whole):
                words.extend(x[0] for x in self.read_cached(whole))
            elif len(single) >= 3 and len(last) in (2, 3) and self._known(last + whole):
                words[-1] = self._known(last + whole)
            else:
                for s in single:
                    words.append(self._known(s, signed))
            single.clear()

        for t in tokens:
            if len(t) == 1:
                single.append(t)
                continue
            if single:
                spell()
            last = t
            r = self.read_cached(t, signed)
            if r is None:
                words.append(frozenset())
                continue
            for labels, _ in r:
                if len(r) == 1 and "@INSULT" in labels and re.search(_MENTION.format(re.escape(t)), line):
                    labels = frozenset({"@META"})
                words.append(labels)
        spell()
        for i in range(1, len(words)):
            if "@PEOPLE" in words[i] and "@TRAIT" in words[i - 1]:
                words[i] = words[i] | {"@GROUP"}

        at: dict[str, list[int]] = {}
        for i, labels in enumerate(words):
            for x in labels:
                at.setdefault(x, []).append(i)
        if not at:
            return {}
        meta = at.get("@META", [])
        best: dict[str, list[float]] = {}
        seen: set[int] = set()
        for x in at:
            for n in self.by_slot.get(x, ()):
                if n in seen:
                    continue
                seen.add(n)
                weight, step, slots, kind = self.rules[n]
                span = _match(slots, step, at)
                if span is None:
                    continue
                near = sum(span[0] - 12 <= m <= span[1] + 12 for m in meta)
                best.setdefault(kind, []).append(weight * (1.0 if near == 0 else 0.6 if near == 1 else 0.15))
        # The strongest rule counts in full, others add half: two weak ones make a case.
        return {k: max(v) + 0.5 * (sum(v) - max(v)) for k, v in best.items()}

    def _known(self, token: str, signed: bool = False) -> frozenset[str]:
        r = self.read_cached(token, signed)
        return r[0][0] if r else frozenset()


def _match(slots: list[frozenset[str]], step: int, at: dict[str, list[int]]) -> tuple[int, int] | None:
    """First and last word of a place where the slots follow in order, each within `step`."""
    ends: dict[int, int] | None = None
    for slot in slots:
        here = sorted({i for x in slot for i in at.get(x, ())})
        if not here:
            return None
        if ends is None:
            ends = {i: i for i in here}
            continue
        nxt: dict[int, int] = {}
        for i in here:
            for back in range(1, step + 1):
                if i - back in ends:
                    nxt[i] = ends[i - back]
                    break
        if not nxt:
            return None
        ends = nxt
    last = min(ends)
    return ends[last], last


def _strings(x: object) -> Iterator[str]:
    if isinstance(x, str):
        yield x
    elif isinstance(x, dict):
        for k, v in x.items():
            yield k
            yield from _strings(v)
    elif isinstance(x, list):
        for v in x:
            yield from _strings(v)


def abuse_scores(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns in `keep`, a score in [0, 1] and the evidence of each kind.

    Every line of the whole text is read: tokens, also joined by hyphens or
    underscores, spelled with spaces or dots, with signs for letters, look-alike
    or invisible characters, stretched or with letters lost, are matched against
    the lexicon by Levenshtein automata intersected with its trie. Rules over
    the words met, and words of quotation and study around them, give evidence
    for insult, threat, hate and sexual language; the score is 1 - 2^-(evidence).
    Evidence of 1, a score of 0.5, is one plain case.

    Tokens of any length are read: those beyond 24 letters, words run together
    and runs of encoded data as the words they are made of. A line of one word
    is judged too, unless it is one of a list of words.

    A null or empty text has score 0. Texts are independent of one another, so
    there is no shuffle; repeated rows are scored alike.
    """
    types = dict(df.dtypes)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = AbuseScorer()
        for b in it:
            got = [scorer.score(t.as_py() or "") for t in b.column("_text")]
            cols = [pa.array([g[0][k] for g in got], pa.float64()) for k in KINDS]
            # the score is that of the strongest kind
            score = pa.array([1 - math.pow(2, -max(g[0].values())) for g in got], pa.float64())
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], score, *cols, pa.array([g[1] for g in got], pa.int32())], names=[*keep, "score", *KINDS, "lines"])

    rows = df.select(*[df[k] for k in keep], df[text].cast("string").alias("_text"))
    return rows.mapInArrow(run, ", ".join(f"`{k}` {types[k]}" for k in keep) + ", score double, " + ", ".join(f"{k} double" for k in KINDS) + ", lines int")


def abuse_rates(scores: DataFrame, source: str, least: float) -> DataFrame:
    """Documents, flagged documents, rate and mean score per source; null sources together."""
    return scores.groupBy(source).agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("score") >= least).alias("flagged"), F.round(F.avg((F.col("score") >= least).cast("double")), 6).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score"))
