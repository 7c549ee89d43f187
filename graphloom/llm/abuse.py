"""Scoring of texts for abusive, hateful or sexually explicit language.

(1) The written words are restored to lexicon terms.  A Levenshtein automaton of the
word, intersected with the trie of the lexicon, finds terms behind masks, digits,
foreign letters, repeated or swapped letters, spaces or slips.  A word that a public
tokenizer keeps whole is spelled as it was meant and is never mended.
(2) A passage is what stands around a word of weight in its sentence.  Every word has
roles (see :mod:`abuse_lexicon`); a passage is scored by how roles meet in it: an
insult with somebody it is aimed at, harm with a first and a second person, a group
with what is said of it, a body with an act.  Sober company (clinic, court, farm,
another sense of the word) takes weight away.  Hits are counted as quoted where a
quotation mark or a verb of saying introduces them, else as direct.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import abuse_lexicon as lex
from .automaton import IMITATIONS, MASKS, Neighbourhood, Trie, terms_within
from .tokens import VOCABULARIES

#: A text is a case from this score on.
THRESHOLD = 1.0
#: Words before and after a word of weight that form its passage, within its sentence.
WINDOW = 30
#: Distinct words whose restoration a worker keeps before it starts anew.
KEPT_WORDS = 1_000_000
#: Vocabularies whose whole words are taken as spelled right.
ORDINARY_WORDS = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")
#: Least letters for one and for two slips.
ONE_SLIP, TWO_SLIPS = 5, 9
#: What a mended word keeps of its weight: one slip in 7 letters or more, one in less, two.
TRUST = (0.8, 0.65, 0.6)

INVISIBLE = dict.fromkeys(map(ord, "­​‌‍⁠﻿‎‏"))
#: Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans("аеорсухіјѕԁһӏкмтвнгпҮүαοερτυνικηωβᴀｅ", "aeopcyxijsdhlkmtbhrnyyaoeptuvikhwbae")
_SIGNS = re.escape("".join(k for k in IMITATIONS if not k.isalnum()) + MASKS)
_EDGE = "\"'`´‘’‚“”„«»‹›()[]{}<>.,:;?…–—|/\\=~^"
_DOTTED = re.compile(rf"[^\W_](?:[.\-_·•/,][^\W_]){{2,}}")
_SPACED = re.compile(rf"(?<![^\s\"'(„“«»‹:,])(?:[^\W_]|[{_SIGNS}]) (?:(?:[^\W_]|[{_SIGNS}]) ){{1,}}[^\W_](?![^\W_])")
_WORD_PARTS = re.compile(rf"[^\W_{_SIGNS}](?:[^\W_]|[{_SIGNS}])*|[{_SIGNS}](?:[^\W_]|[{_SIGNS}])*[^\W_](?:[^\W_]|[{_SIGNS}])*")
_RUN = re.compile(r"(.)\1{2,}")
_HYPHEN_BREAK = re.compile(r"(?<=[^\W\d_])-\r?\n[ \t]*(?=[^\W\d_])")
_OPENS = re.compile(r"[\"“„«‹‘(\[]|'\w")
_CLOSES = re.compile(r"[\"”»›’')\]][.,:;!?]*$|[”»›]")
_STOPS = re.compile(r"[.!?;][\"”’»›')\]]*$")
_MARKS = re.compile(r"[\"“”„«»‘‹›]|(?<!\w)'|\(")

_WEIGHTY = frozenset("slur mild beast tame moral slang group harm hurt miss wish live deserve alive low purge breed taint crude lewd part act solo favour punish pen bare crime".split())
_NOUNS = {"slur": 1.0, "slang": 1.0, "mild": 0.6, "beast": 0.4, "tame": 0.3}
_HARM = frozenset("harm hurt".split())
_WISHES = frozenset("wish deserve miss know favour shame".split())
_SAID_OF_GROUPS = frozenset("low beast breed crime taint purge expel pen slang harm".split())
_BODIES = frozenset("crude lewd part act solo bare hint".split())
_SLIPPED = frozenset("slur mild beast moral slang low crude lewd".split())
_OWN = frozenset("my your his her their ma ta sa mon ton son mein meine meinen meiner dein deine deinen deiner sein seine seinen seines ihre ihren ihr".split())
_OBJECT = frozenset("me him her them you mich dich sie ihn ihr mir dir la le lui te vous herself himself myself".split())
_DIRECT = frozenset("you ya u youre du dich dir euch tu toi te vous eres sei jij ty usted".split())
_ARTICLES = frozenset("a an the ein eine einen einem un une le la les der die das den".split())
_ADJECTIVAL = ("ing", "y", "ish", "less", "ful", "ous", "ic", "le", "e", "er", "es", "en", "al", "ive")
_STRIKES = frozenset("""beat beats hit punch kick whip hurt bash smash crush bury hunt thrash batter flog burn schlage schlagen haue hauen trete treten prugle prugeln verprugeln ramme
frapper cogner defoncer demolir ecraser ecraserai exploser""".split())
_BURNS = frozenset("burn smash zunde zunden anzunden anzunde bruler brulerai mettrai mettre".split())
_ENDINGS = ("s", "es", "ed", "d", "ing", "ly", "e", "n", "en", "er")
_COARSE = frozenset("fuck fucks fucked fucking screw screwing screwed bang banging shag shagging shagged hump humping".split())
_CONTESTS = frozenset("court appeal game match trial election race prix".split())
_PEOPLE = frozenset(lex.THIRD + lex.MOTHERS + "man woman person guy boy girl fellow boss chairman officer witness tenant landlord doctor teacher mann kerl typ chef zeuge mieter homme femme type mec patron temoin".split())


def fold(s: str) -> str:
    """Lower case, Latin letters for their lookalikes, no accents, no invisible characters."""
    if s.isascii():
        return s.lower()
    s = unicodedata.normalize("NFKD", s.translate(INVISIBLE).lower().translate(LOOKALIKES))
    return "".join(c for c in s if not unicodedata.combining(c)).replace("ß", "ss").replace("œ", "oe").replace("æ", "ae")


def inflections(word: str, kind: str) -> set[str]:
    """The forms of a word under the inflection of its row."""
    w = fold(word)
    if kind == "n":
        if w.endswith(("s", "sh", "ch", "x")):
            return {w, w + "es"}
        return {w, w[:-1] + "ies"} if w.endswith("y") and w[-2] not in "aeiou" else {w, w + "s"}
    if kind == "v":
        if w.endswith("e"):
            return {w, w + "s", w + "d", w[:-1] + "ing"}
        last = w[-1] if re.search(r"[^aeiou][aeiou][bdgklmnprt]$", w) and len(w) <= 5 else ""
        third = w + "es" if w.endswith(("s", "sh", "ch", "x")) else w + "s"
        return {w, third, w + "ed", w + "ing"} | ({w + last + "ed", w + last + "ing"} if last else set())
    if kind == "a":
        return {w, *((w if not w.endswith("e") else w[:-1]) + e for e in ("e", "er", "es", "en", "em"))}
    if kind == "f":
        return {w, w + "s", w + "e", w + "es"} if not w.endswith("e") else {w, w + "s"}
    if kind == "r":
        return {w[:-2] + e for e in ("er", "e", "es", "ez", "ent", "ait", "ais", "aient", "ant", "erai", "era", "erait", "erais", "ee", "ees")} | {w[:-2] + "e"}
    if kind == "g":
        return {w, *(w[:-2] + e for e in ("e", "st", "t", "te", "ten", "end")), "ge" + w[:-2] + "t"}
    return {w}


def ordinary_words(folder: str, names: tuple[str, ...] = ORDINARY_WORDS) -> frozenset[str]:
    """Folded words of letters that stand whole in a public vocabulary; empty if its file is not there."""
    out = set()
    for name in names:
        path = Path(folder) / name
        if not path.exists():
            continue
        for line in path.read_bytes().splitlines():
            token = base64.b64decode(line.split()[0])
            if token[:1] == b" ":
                w = token[1:].decode("utf-8", "ignore")
                if len(w) >= 4 and w.isalpha():
                    out.add(fold(w))
    return frozenset(out)


class Chunk(NamedTuple):
    """What stands between two blanks: restored words, the trust in each, and its marks."""

    words: tuple[str, ...]
    trust: tuple[float, ...]
    capital: bool
    opens: bool
    closes: bool
    stops: bool
    bang: bool
    colon: bool


class Passage:
    """Words of one sentence with their roles, and the hits found among them."""

    def __init__(self, lexicon: Lexicon, chunks: list[Chunk], at_start: bool):
        self.lexicon = lexicon
        self.w: list[str] = []
        self.trust: list[float] = []
        self.capital: list[bool] = []
        self.span: list[int] = []
        self.first: list[bool] = []
        self.stop: list[bool] = []
        span, fresh = 0, at_start
        for c in chunks:
            if c.opens:
                span, fresh = span + 1, True
            for k, (w, t) in enumerate(zip(c.words, c.trust, strict=True)):
                self.w.append(w)
                self.trust.append(t)
                self.capital.append(c.capital and k == 0)
                self.span.append(span)
                self.first.append(fresh and k == 0)
                self.stop.append(c.stops and k == len(c.words) - 1)
            fresh = c.stops or not c.words and fresh
            if c.closes or c.colon:
                span += 1
                fresh = fresh or c.colon
        self.bang = bool(chunks) and chunks[-1].bang
        roles = lexicon.roles_of(self.w, self.span)
        none = frozenset()
        self.r = [roles.get(w, none) for w in self.w]
        self.all = none.union(*self.r)
        self.hits: list[tuple[str, float, str]] = []

    def any_word(self, words, lo: int, hi: int) -> bool:
        return any(w in words for w in self.w[max(0, lo) : max(0, hi)])

    def where(self, role: str, lo: int, hi: int) -> int | None:
        for i in range(max(0, lo), min(len(self.w), hi)):
            if role in self.r[i]:
                return i
        return None

    def hit(self, category: str, weight: float, what: str) -> None:
        self.hits.append((category, weight, what))

    def near_span(self, i: int) -> set[str]:
        return {w for w, s in zip(self.w, self.span, strict=True) if s == self.span[i]}

    def is_you(self, i: int) -> bool:
        """Whether the word addresses somebody (``ihr`` and ``sie`` only right before a noun or adjective)."""
        w = self.w[i]
        if w in _DIRECT:
            return True
        if w in ("ihr", "sie") and i + 1 < len(self.w):
            after = self.w[i + 1 :]
            if after[0] in ("seid", "sind"):
                return w == "ihr" or len(after) > 2 and after[1] in ("doch", "ein", "eine", "nur", "so")
            k = i + 1
            while k < len(self.w) and self.r[k] & {"moral", "looks", "much"}:
                k += 1
            return k < len(self.w) and bool(self.r[k] & _NOUNS.keys()) and not (w == "ihr" and self.w[k] in lex.HERS)
        return False

    def score(self) -> dict[str, float]:
        self.idioms()
        if self.all & _NOUNS.keys():
            self.nouns()
        if "moral" in self.all:
            self.adjectives()
        if self.all & _HARM:
            self.threats()
        if self.all & _WISHES or any(w in ("you", "du", "tu", "toi", "vous", "better", "besser", "mieux") for w in self.w):
            self.wishes()
        if self.all & _SAID_OF_GROUPS or not lex.STARTS_OF_GROUPS.isdisjoint(self.w):
            self.groups()
        if self.all & _BODIES:
            self.bodies()
        best: dict[str, float] = {}
        for category, weight, _ in self.hits:
            best[category] = max(best.get(category, 0.0), weight)
        return best

    # what insults

    def idioms(self) -> None:
        for i, w in enumerate(self.w):
            for category, weight, parts in self.lexicon.idioms.get(w, ()):
                j, skipped = i + 1, len(parts) < 3
                for options in parts[1:]:
                    if j < len(self.w) and self.w[j] not in options and not skipped:
                        j, skipped = j + 1, True
                    if j >= len(self.w) or self.w[j] not in options:
                        break
                    j += 1
                else:
                    self.hit(category, weight, w)

    def nouns(self) -> None:
        for i, roles in enumerate(self.r):
            kinds = roles & _NOUNS.keys()
            if not kinds:
                continue
            kind = max(kinds, key=_NOUNS.get)
            extra, aimed = self.target(i, kind)
            weight = _NOUNS[kind] * self.trust[i] + extra
            senses = self.lexicon.senses.get(self.w[i])
            if senses and not aimed and not senses.isdisjoint(self.near_span(i)):
                weight -= 1.0
            self.hit("hateful" if kind == "slang" else "abusive", min(weight, 1.5), self.w[i])

    def target(self, i: int, kind: str) -> tuple[float, bool]:
        """What the surroundings add to a noun, and whether it is aimed at somebody spoken to."""
        add = run_down = 0.0
        aimed = be = article = False
        odd = 0
        for j in range(i - 1, max(-1, i - 9), -1):
            w, r = self.w[j], self.r[j]
            if self.stop[j]:
                break
            if w in ("eres", "sei", "bist", "seid", "etes"):
                add, aimed = 0.8, True
                break
            if self.is_you(j):
                if be or not article and (odd == 0 or odd == 1 and self.w[j + 1].endswith(_ADJECTIVAL)):
                    add, aimed = 0.8, True
                break
            if w in lex.BE and (w != "s" or not be):
                be = True
            elif "moral" in r and not be:
                run_down = max(run_down, 0.6 * self.trust[j])
            elif "much" in r and w in ("fucking", "fuckin", "goddamn", "bloody", "damned") and not be:
                run_down = max(run_down, 0.4)
            elif "looks" in r and not be:
                run_down = max(run_down, 0.35)
                if w in ("sale", "sales", "pauvre") and j == i - 1:
                    add = 0.6
                    break
            elif "much" in r:
                run_down += 0.2
            elif w in ("what", "such", "espece", "especes", "bande", "tas", "quel", "quelle", "sacre", "pareil", "welch"):
                add = 0.6
                break
            elif w in lex.NAMING:
                add = 0.6 if article or kind not in ("beast", "tame") else 0.0
                break
            elif w in lex.FILLERS or w in ("als", "wie"):
                article = article or w in _ARTICLES
            elif be:
                known = w in _PEOPLE and w not in ("la", "le")
                name = self.capital[j] and (j == 0 or self.w[j - 1] not in _ARTICLES or w.endswith("s"))
                add = 0.6 if known or name and not self.lexicon.is_ordinary(w) else 0.35 if kind == "mild" else 0.0
                break
            elif odd < 2 and w.isalpha() and not self.capital[j] and not self.span[j] != self.span[i]:
                odd += 1
            else:
                break
        if not add and self.any_word(lex.NAMING, i - 9, i) and (article or kind not in ("beast", "tame")):
            add = 0.6
        after = self.w[i + 1 : i + 4]
        if after[:2] in (["like", "you"], ["wie", "du"], ["wie", "ihr"], ["wie", "sie"], ["comme", "toi"], ["comme", "vous"], ["you", "are"], ["du", "bist"], ["tu", "es"]) or after == ["that", "you", "are"]:
            add, aimed = max(add, 0.8), True
        if self.any_word(("only", "nur", "seul"), i - 5, i) and self.any_word(("would", "could", "wurde", "kann", "ferait", "peut"), i + 1, i + 3):
            add = max(add, 0.4)
        if add and be and self.any_word(lex.KNOWN_BY_ALL, i + 1, i + 7):
            run_down += 0.2
        if self.bang and len(self.w) <= 6:
            add = max(add, 0.4)
        return add + run_down, aimed

    def adjectives(self) -> None:
        """Words that run somebody down as predicates: you are ..., a group is ..., what a ... you are."""
        for i, roles in enumerate(self.r):
            if "moral" not in roles or self.w[i] in ("lying", "menteur"):
                continue
            j = i - 1
            while j >= 0 and not self.stop[j] and (self.w[j] in lex.FILLERS or self.w[j] in ("too", "zu", "trop", "so", "si") or "much" in self.r[j] or self.r[j] & {"moral"}):
                j -= 1
            if j < 0 or self.stop[j]:
                continue
            if self.is_you(j) and j == i - 1:
                self.hit("abusive", 0.8 * self.trust[i], self.w[i])
            elif self.w[j] in lex.BE and j > 0:
                if self.is_you(j - 1) or self.w[j - 1] in ("n", "ne") and j > 1 and self.is_you(j - 2):
                    self.hit("abusive", 1.0 * max(self.trust[i], 0.8), self.w[i])
                elif self.where("group", j - 3, j) is not None or self.where("slang", j - 3, j) is not None:
                    self.hit("hateful", 1.0, self.w[i])
            elif self.w[j] in ("what", "quel", "quelle") and any(self.w[k] in ("you", "du", "tu", "vous") for k in range(i + 1, min(len(self.w), i + 9))):
                self.hit("abusive", 1.0, self.w[i])

    # harm to the person spoken to

    def threats(self) -> None:
        for i, roles in enumerate(self.r):
            strong, weak = "harm" in roles, "hurt" in roles
            if not (strong or weak):
                continue
            word, n = self.w[i], len(self.w)
            after = min(n, i + 7)
            if i + 1 < n and "self" in self.r[i + 1] and strong and not self.any_word(("did", "might", "could", "had"), i - 3, i):
                self.hit("abusive", 1.0, word)
            you_after = next((k for k in range(i + 1, after) if self.w[k] in lex.YOU and self.w[k] not in ("te", "ti")), None)
            if you_after is None and i + 1 < n and self.w[i + 1] in ("dir", "dich", "euch"):
                you_after = i + 1
            firsts = [k for k in range(max(0, i - 7), min(n, i + 2)) if self.w[k] in lex.FIRST]
            first = firsts[-1] if firsts else None
            if first is not None and not self.any_word(lex.NOT, first, i + 1) and not self.any_word(("that",), first, i):
                lo = min(first, i)
                meant = self.any_word(lex.WILL, lo, i) or self.any_word(("to", "wanna"), lo, i) and self.any_word(("want", "going", "love", "swear"), lo, i) or first > i or self.w[first] in ("ich", "wir", "je", "j")
                you_before = any(self.w[k] in ("dich", "dir", "dein", "deine", "deinen", "te", "t", "vous", "euch") for k in range(max(0, lo - 2), i))
                you = you_after is not None or you_before
                flesh = self.where("flesh", i - 4 if you_before else i + 1, after + 1) is not None
                if meant and you and (strong or flesh and weak):
                    self.hit("abusive", 1.0, word)
                elif meant and strong and word not in ("tue", "tote") and i + 1 < n and self.w[i + 1] in ("him", "her", "them") and not self.any_word(("for",), i, i + 3):
                    self.hit("abusive", 1.0, word)
                elif meant and you and weak and word in _STRIKES and (you_before or you_after == i + 1 and self.w[you_after] in _DIRECT) and not self.any_word(_CONTESTS, i, i + 6):
                    self.hit("abusive", 1.0, word)
                elif meant and you and word in _BURNS and self.where("home", i - 4 if you_before else i + 1, min(n, i + 9)) is not None:
                    self.hit("abusive", 1.0, word)
                elif meant and word == "cut" and you_after == i + 1 and self.any_word(("up", "into", "open", "down"), i + 2, i + 4):
                    self.hit("abusive", 1.0, word)
                elif meant and word in _BURNS and self.where("home", i + 1, min(n, i + 9)) is not None and self.any_word(_DIRECT, i + 1, i + 12):
                    self.hit("abusive", 1.0, word)
            ought = self.where("ought", i - 6, i)
            if ought is not None and strong:
                if you_after is not None and you_after <= i + 2 and self.w[you_after] in _DIRECT or ought > 0 and self.w[ought - 1] in ("you", "du", "tu") and self.any_word(("be", "have"), ought, i):
                    self.hit("abusive", 1.0, word)

    def wishes(self) -> None:
        """Wishes of harm, being told to die, being watched, not being missed."""
        w, r, n = self.w, self.r, len(self.w)
        for i in range(n):
            roles = r[i]
            if "wish" in roles:
                you = next((k for k in range(i + 1, min(n, i + 10)) if w[k] in lex.YOU or w[k] in ("they", "someone", "somebody", "he", "she") and "die" not in r[k]), None)
                die = self.where("die", i + 1, i + 9)
                if die is None:
                    die = self.where("harm", i + 1, i + 11)
                if die is None:
                    die = self.where("hurt", i + 1, i + 11)
                if you is not None and die is not None and (w[you] in lex.YOU or any(x in _DIRECT for x in w[die : die + 4])) and not any(x in lex.NOT for x in w[i + 1 : die]):
                    self.hit("abusive", 1.0, w[i])
                if die is not None and w[die] in ("stirbst", "verreckst", "krepierst", "erstickst"):
                    self.hit("abusive", 1.0, w[i])
            if "deserve" in roles:
                p = self.where("punish", i + 1, i + 5)
                d = self.where("die", i + 1, i + 4)
                if p is not None or d is not None:
                    self.hit("abusive", 1.0, w[i])
            if "miss" in roles and self.where("nobody", i - 5, i) is not None and any(x in lex.YOU for x in w[max(0, i - 3) : i + 3]):
                sure = w[i] not in ("miss", "vermissen", "vermisst") or self.any_word(("if", "when", "wenn", "falls", "si", "once", "were"), i, i + 4)
                self.hit("abusive", 1.0 if sure else 0.8, w[i])
            if "know" in roles and self.any_word(("where", "wo", "ou"), i + 1, i + 3) and self.any_word(("i", "we", "ich", "wir", "je", "nous", "on"), i - 2, i + 2):
                live = self.where("live", i + 2, i + 9)
                if live is not None and (self.any_word(lex.YOU, i + 2, live + 1) or self.any_word(("dorment", "dort"), live, live + 1)):
                    self.hit("abusive", 1.0, w[i])
            if "favour" in roles and (self.where("die", i + 1, i + 9) is not None or self.where("harm", i + 1, i + 9) is not None or self.any_word(lex.ENDS, i + 1, i + 10)):
                self.hit("abusive", 1.0, w[i])
            if "shame" in roles and (a := self.where("alive", i + 1, i + 10)) is not None and self.any_word(_DIRECT, i + 1, a + 1):
                self.hit("abusive", 1.0, w[i])
            if w[i] in ("you", "du", "tu") and i + 2 < n and w[i + 1] in ("will", "ll", "shall", "wirst", "vas") and any(x in ("die", "rot", "bleed", "sterben", "verrecken", "crever", "mourir") for x in w[i + 2 : i + 4]):
                self.hit("abusive", 1.0, w[i])
            if w[i] == "you" and i > 1 and w[i - 1] == "like" and "folk" in r[i - 2] and (self.where("ought", i + 1, i + 3) is not None or self.any_word(("belong", "make", "deserve"), i + 1, i + 4)):
                self.hit("abusive", 1.0, w[i])
            if w[i] in ("du", "toi", "vous", "sie") and i > 1 and w[i - 1] in ("wie", "comme") and "folk" in r[i - 2] and self.where("ought", i + 1, i + 4) is not None:
                self.hit("abusive", 1.0, w[i])
            if w[i] in ("you", "du", "tu") and self.any_word(("belong", "belongs", "gehorst"), i + 1, i + 3) and self.where("pen", i + 2, i + 7) is not None:
                self.hit("abusive", 1.0, w[i])
            if w[i] in ("better", "besser", "mieux") and self.any_word(("without", "ohne", "sans"), i + 1, i + 4) and self.any_word(_DIRECT, i + 2, i + 6) and self.any_word(("world", "welt", "monde"), i - 7, i + 1):
                self.hit("abusive", 1.0, w[i])

    # groups of people

    def peoples(self) -> list[int]:
        """Where groups of people are named: known ones, and unknown names that are spoken of as a kind."""
        out = []
        for i, roles in enumerate(self.r):
            after = self.w[i + 1 : i + 4]
            if roles & {"group", "slang"} or "folk" in roles and (after[:1] == ["of"] and len(after) > 2 and after[2] in lex.KINDS or i and (self.w[i - 1] in ("those", "these", "such", "diese", "ces") or self.w[i] == "folk" and self.w[i - 1] not in _ARTICLES)):
                out.append(i)
            elif self.capital[i] and self.w[i].isalpha() and not self.lexicon.is_ordinary(self.w[i]):
                lead = self.w[i - 1] if i else ""
                many = self.w[i].endswith(("s", "i", "n", "er", "en", "men", "x", "u", "o", "a"))
                if i + 1 < len(self.w) and "folk" in self.r[i + 1] or (lead in lex.ALL or lead in ("no", "keine", "an", "kein", "that", "filthy")) and many:
                    out.append(i)
                elif after[:1] and (after[0] in lex.KIND_VERBS or after[0] in ("they", "sie", "ils", "elles")) and many:
                    out.append(i)
        return out

    def groups(self) -> None:
        w, r, n = self.w, self.r, len(self.w)
        g = self.peoples()
        they = [i for i in range(n) if w[i] in ("they", "them", "ils", "elles", "these", "those")]
        low = [i for i in range(n) if r[i] & {"low", "beast"}]
        prey = any("prey" in r[i] and not (i and w[i - 1] in ("like", "wie", "comme", "des", "die")) and not any(x in lex.BE for x in w[max(0, i - 3) : i]) for i in range(n))
        if prey and not g:
            return
        for i in range(n):
            if "breed" in r[i] and self.any_word(("like", "wie", "comme"), i + 1, i + 3) and (s := self.where("swarm", i + 2, i + 6)) is not None and s - i <= 4:
                self.hit("hateful", 1.0, w[i])
            if w[i] in ("subhuman", "subhumans", "untermensch", "untermenschen") or w[i] == "sous" and i + 1 < n and w[i + 1] == "hommes":
                self.hit("hateful", 1.0 * self.trust[i] + (0.2 if g or they else 0.0), w[i])
            if w[i] in ("dead", "mort", "morte", "morts", "toter", "totes", "tote", "tot") and self.any_word(("good", "bon", "bonne", "guter", "gutes", "gute"), 0, n):
                twice = [x for x in set(w) if len(x) >= 4 and x.isalpha() and sum(y[:5] == x[:5] for y in w) > 1 and x not in ("good", "dead", "only")]
                only = next((j for j in range(i) if w[j] == "only" and w[j + 1] == "good"), None)
                if twice or only is not None and i - only <= 9 and self.any_word(lex.BE, only, i):
                    self.hit("hateful", 1.0, w[i])
        for k in low:
            be = next((j for j in range(k - 1, max(-1, k - 7), -1) if w[j] in lex.BE), None)
            if be is None:
                continue
            subject = [j for j in g if be - 5 <= j < be]
            if subject and w[k] not in ("dirt", "mist", "crap"):
                self.hit("hateful", 1.0 * self.trust[k] + 0.2, w[k])
            elif any(be - 3 <= j < be for j in they) or w[be - 1 : be] in (["sie"], ["c"], ["ce"]):
                ought = self.where("purge", 0, n) is not None or self.where("expel", 0, n) is not None
                lower = self.any_word(("less", "worse", "better"), be + 1, k) and self.any_word(("than",), be + 1, k)
                self.hit("hateful", 1.0 if ought or g or lower else 0.6, w[k])
        for k in range(n):
            if "crime" in r[k] and any(k - 8 <= j < k for j in g) and (self.any_word(("all", "every", "alle", "tous", "toutes", "race"), k - 10, k) or any("group" in r[j] and self.any_word(lex.BE, j, k) for j in g if j < k)):
                self.hit("hateful", 1.0, w[k])
            if "taint" in r[k] and w[k] not in ("blood", "blut", "sang"):
                two = sum("taint" in x for x in r) > 1 or self.any_word(("spread", "stink"), 0, n) and sum("taint" in x or "breed" in x for x in r) > 1
                if two or w[k] in ("stink", "stinks", "stinken", "puent"):
                    self.hit("hateful", (0.6 if two else 0.3) + (0.4 if any(abs(j - k) <= 12 for j in g) else 0.0), w[k])
            if "purge" in r[k] or "expel" in r[k] and w[k] in ("put", "driven") and self.any_word(("down", "out", "into"), k + 1, k + 2):
                ought = self.where("ought", k - 8, k + 2)
                if ought is None:
                    continue
                subject = any(j < k and ought - 7 <= j <= k + 4 or k < j <= k + 4 for j in g)
                if subject and not (prey and not any(r[j] & {"group", "slang"} for j in g)):
                    self.hit("hateful", 1.0, w[k])
                elif not prey and low and any(w[j] in ("they", "those", "these", "sie", "ils", "les") for j in range(max(0, k - 12), k)):
                    self.hit("hateful", 1.0, w[k])
                elif not prey and (w[k] in ("exterminated", "gassed", "lynched", "ausgerottet", "vergast", "exterminer", "gazer", "culled") or k + 1 < n and w[k] in ("wiped", "hunted") and w[k + 1] in ("out", "off")):
                    self.hit("hateful", 0.7 + (0.3 if self.any_word(("they", "those", "these", "sie", "les", "people"), k - 10, k) else 0.0), w[k])
            if "expel" in r[k] and w[k] in ("raus", "dehors") and any(k - 3 <= j < k for j in g):
                self.hit("hateful", 1.0, w[k])
            if "expel" in r[k] and w[k] in ("deported", "expelled", "abgeschoben", "expulser") and any(k - 9 <= j < k for j in g):
                self.hit("hateful", 0.4 + (0.6 if low else 0.0), w[k])
            if w[k] in ("belong", "belongs", "gehoren", "gehort") and self.where("pen", k + 1, k + 6) is not None and (any(k - 7 <= j < k for j in g) or any(k - 4 <= j < k for j in they)):
                self.hit("hateful", 1.0, w[k])
            if w[k] == "gehoren" and any(k - 4 <= j < k for j in g) and self.any_word(("wand", "galgen", "ofen", "lager"), k + 1, k + 5):
                self.hit("hateful", 1.0, w[k])
            if w[k] in ("no", "keine", "kein", "pas") and any(k < j <= k + 3 for j in g) and self.any_word(("in", "im", "dans"), k + 2, k + 6) and self.where("place", k + 3, k + 9) is not None:
                self.hit("hateful", 1.0, w[k])
            if w[k] in ("send", "put", "throw", "ship") and self.where("pen", k + 2, k + 15) is not None and (any(k < j <= k + 8 for j in g) or w[k + 1 : k + 2] == ["them"] and (g or "back" in w[k : k + 4])):
                self.hit("hateful", 1.0, w[k])
            if ("harm" in r[k] or w[k] in ("burn", "gas", "gazez", "vergast", "vergasen", "verbrennt")) and any(k < j <= k + 6 for j in g):
                called = self.first[k] or self.where("ought", k - 6, k) is not None or k and w[k - 1] in ("let", "lets", "us", "please", "just")
                if called and not any("court" in x for x in r):
                    self.hit("hateful", 1.0, w[k])
            if w[k] in ("hire", "employ", "serve", "rent", "vermietet", "vermieten", "bedienen", "embauchons", "louons") and any(k - 6 <= j <= k + 6 for j in g) and self.any_word(lex.NOT, k - 4, k) and (self.any_word(("we", "wir", "nous", "on"), k - 6, k) or w[k] == "vermietet"):
                self.hit("hateful", 1.0, w[k])

    # acts and bodies

    def bodies(self) -> None:
        sexual = [i for i, x in enumerate(self.r) if x & {"crude", "lewd", "part", "act", "solo", "limb", "hint", "bare"}]
        if not any(self.r[i] & {"crude", "lewd", "part", "act", "solo", "bare"} or self.w[i] in ("inside", "spread") for i in sexual):
            return
        start = 0
        for at, i in enumerate(sexual):
            if at + 1 == len(sexual) or sexual[at + 1] - i > 9:
                self.body(sexual[start : at + 1])
                start = at + 1

    def body(self, at: list[int]) -> None:
        w, r = self.w, self.r
        total, seen, moves = 0.0, set(), False
        for i in at:
            x = r[i]
            sober = self.lexicon.senses.get(w[i])
            if w[i] in seen or sober and not sober.isdisjoint(self.near_span(i)):
                continue
            seen.add(w[i])
            worth = max((v for k, v in (("crude", 1.0), ("solo", 0.7), ("lewd", 0.5), ("act", 0.35), ("part", 0.25), ("hint", 0.15), ("limb", 0.1)) if k in x), default=0.0) * self.trust[i]
            if x & {"lewd", "part", "limb"} and self.any_word(_OWN, i - 2, i):
                worth += 0.2
            if x & {"lewd", "part"} and (self.where("firm", i - 2, i) is not None or self.where("firm", i + 1, i + 3) is not None):
                worth += 0.4
            if x & {"act", "lewd", "hint"}:
                if self.any_word(_OBJECT, i + 1, i + 2) or x & {"act", "lewd"} and self.any_word(("la", "te", "lui", "dich", "sie", "vous"), i - 1, i):
                    worth += 0.2 + (0.1 if self.any_word(("la", "te", "lui", "dich"), i - 1, i) else 0.0)
                if w[i] in _COARSE and (self.any_word(_OBJECT, i + 1, i + 2) or self.any_word(lex.PARTNERS, i + 1, i + 4)):
                    worth += 0.5
                if "act" in x and self.any_word(("into", "inside", "between"), i + 1, i + 3) and self.any_word(_OBJECT | _OWN, i + 2, i + 4):
                    worth += 0.3
                if w[i] == "inside" and self.where("lust", i - 4, i) is not None and self.any_word(_OBJECT | {"it"}, i - 1, i) and self.any_word(_OBJECT, i + 1, i + 2):
                    worth += 0.7
                if w[i] == "spread" and self.any_word(("her", "your"), i + 1, i + 2) and self.any_word(("legs", "thighs"), i + 2, i + 3):
                    worth += 0.5
                if x & {"act", "lewd"} and (self.where("lust", i - 5, i) is not None or self.where("lust", i + 1, i + 2) is not None):
                    worth += 0.2
            if x & {"lewd", "part"} and self.any_word(("picture", "pictures", "photo", "photos", "image", "bild", "bilder", "foto", "photographie"), i - 6, i):
                worth += 0.2
            if x & {"lewd", "part"} and (a := self.where("ask", i - 7, i)) is not None and self.any_word(lex.YOU, a + 1, i):
                worth += 0.6
            if "bare" in x and self.any_word(("take", "takes", "took", "off", "zieh", "enleve", "ote"), i - 4, i) and self.any_word(("your", "deine", "dein", "ta", "tes", "her", "ihre"), i - 3, i):
                worth += 0.6
            if w[i] == "bend" and w[i + 1 : i + 2] == ["over"]:
                worth += 0.4
            if w[i] == "came" and any("solo" in r[k] for k in at) and self.any_word(("on", "over", "onto", "in", "inside"), i + 1, i + 2):
                worth += 0.2
            moves = moves or bool(x & {"crude", "lewd", "act", "solo"}) or worth >= 0.5
            total += worth
        if not moves:
            return
        span = self.near_span(at[0]) | self.near_span(at[-1])
        known = dict(zip(w, r, strict=True))
        clinic = sum("clinic" in known[x] for x in span)
        court = sum("court" in known[x] for x in span)
        total -= min(1.4, 0.7 * clinic) + min(1.0, 0.4 * court)
        self.hit("sexual", total, w[at[0]])


class Lexicon:
    """The compiled terms, and what is known of the words seen so far."""

    def __init__(self, folder: str = VOCABULARIES):
        self.tables: dict[str, dict[str, set[str]]] = {"*": {}, "en": {}, "de": {}, "fr": {}}
        for role, language, kind, words in lex.TERMS:
            for word in words.split():
                for form in inflections(word, kind):
                    self.tables[language].setdefault(form, set()).add(role)
        self.merged: dict[tuple[str, ...], dict[str, frozenset[str]]] = {}
        self.role: dict[str, set[str]] = {}
        for table in self.tables.values():
            for w, roles in table.items():
                self.role.setdefault(w, set()).update(roles)
        self.heads = {h: role for role, heads in lex.COMPOUND_HEADS.items() for h in heads.split()}
        self.firsts = tuple(lex.COMPOUND_FIRSTS.split())
        self.terms = {w for w, roles in self.role.items() if roles & _WEIGHTY}
        small = {w for words in lex.SMALL.values() for w in words}
        self.known = set(self.role) | small | {w for _, words in lex.SENSES for w in words.split()} | {*lex.YOU, *lex.FILLERS, *lex.BE, *lex.SAYING}
        self.ordinary = ordinary_words(folder) - self.role.keys()
        self.trie = Trie(sorted(t for t in self.terms if len(t) >= 3))
        slips = {w for w, roles in self.role.items() if roles & _SLIPPED and len(w) >= ONE_SLIP}
        self.slip_trie = Trie(sorted(slips))
        self.longest = max(map(len, self.terms)) + 2
        self.one, self.two = Neighbourhood(slips, 1), Neighbourhood([w for w in slips if len(w) >= TWO_SLIPS - 1], 2)
        self.doubled = {w for w, roles in self.role.items() if roles & _SLIPPED and len(w) == 4}
        self.senses: dict[str, set[str]] = {}
        for terms, words in lex.SENSES:
            for t in terms.split():
                self.senses.setdefault(t, set()).update(words.split())
        self.idioms: dict[str, list[tuple[str, float, list[frozenset[str]]]]] = {}
        for category, weight, rows in lex.IDIOMS:
            for row in rows.split(";"):
                parts = [frozenset(x.split("|")) for x in row.split()]
                for first in parts[0]:
                    self.idioms.setdefault(first, []).append((category, weight, parts))
        # One word of every idiom, and the few words without a weighty role, that make a passage worth reading.
        common = small | {*lex.YOU, *lex.FILLERS, *lex.BE, *lex.SAYING, *lex.WEAK_STARTS}
        self.starts = set(lex.STARTS)
        for rows in self.idioms.values():
            for _, _, parts in rows:
                self.starts |= next((p for p in reversed(parts) if common.isdisjoint(p)), frozenset()) or frozenset().union(*parts) - common
        self.saying = set(lex.SAYING)
        self.chunks: dict[str, Chunk] = {}
        self.plain: set[str] = set()
        self.hot: set[str] = set()

    # words

    def spelled_right(self, w: str) -> bool:
        """Whether a public vocabulary holds the word, or the word without a common ending."""
        return w in self.ordinary or any(w.endswith(e) and w[: -len(e)] in self.ordinary for e in _ENDINGS)

    def is_ordinary(self, w: str) -> bool:
        return w in self.known or self.spelled_right(w)

    def roles_of(self, words: list[str], spans: list[int]) -> dict[str, frozenset[str]]:
        """word -> roles in the languages that the words look like; a quotation may be in one of its own."""
        counts: dict[int, dict[str, int]] = {}
        for w, s in zip(words, spans, strict=True):
            mine = counts.setdefault(s, {})
            for k, small in _SMALL.items():
                if w in small:
                    mine[k] = mine.get(k, 0) + 1
        key = tuple(sorted({k for mine in counts.values() for k, c in mine.items() if 2 * c >= max(mine.values())})) or ("de", "en", "fr")
        got = self.merged.get(key)
        if got is None:
            merged: dict[str, set[str]] = {w: set(r) for w, r in self.tables["*"].items()}
            for k in key:
                for w, r in self.tables[k].items():
                    merged.setdefault(w, set()).update(r)
            got = self.merged[key] = {w: frozenset(r) for w, r in merged.items()}
        return got

    def compound(self, low: str) -> str | None:
        """The insulting head of a German compound."""
        for cut in range(max(3, len(low) - 11), len(low) - 3):
            role = self.heads.get(low[cut:])
            if role and (role == "slur" or low[:cut].startswith(self.firsts)):
                return low[cut:] if low[cut:] not in ("kopf", "pfosten") else "dummkopf"
        return None

    def restore_word(self, raw: str) -> tuple[str, float]:
        """The term behind one written word, or the word itself, folded; and the trust in it."""
        low = fold(raw)
        if low in self.known:
            return low, 1.0
        if low.isalpha():
            short = _RUN.sub(r"\1", low)
            if short != low or not raw.isascii() and any(ord(c) > 0x36F for c in raw):
                for s in (short, _RUN.sub(r"\1\1", low)):
                    if s in self.known:
                        return s, 1.0
                    if 6 <= len(s) <= self.longest and (found := terms_within(self.trie, s, 1)):
                        return found[0][1], 1.0
            if self.spelled_right(low):
                return low, 1.0
            if len(low) == 5:
                for i in range(1, 5):
                    if low[i] == low[i - 1] and low[:i] + low[i + 1 :] in self.doubled:
                        return low[:i] + low[i + 1 :], 0.9
            if not ONE_SLIP <= len(low) <= self.longest:
                return (self.compound(low) or low, 1.0) if len(low) >= 8 else (low, 1.0)
            if self.one.may_hold(low):
                found = [t for _, t in terms_within(self.slip_trie, low, 1) if t[0] == low[0] or t[:2] == low[1::-1]]
                found = [t for t in found if not self.inflected(low, t)]
                if found:
                    return found[0], TRUST[0] if len(low) >= 7 else TRUST[1]
            if len(low) >= 8 and (head := self.compound(low)):
                return head, 1.0
            if len(low) >= TWO_SLIPS and self.two.may_hold(low):
                found = [t for _, t in terms_within(self.slip_trie, low, 2) if t[0] == low[0] and t[-1] == low[-1] and len(t) >= TWO_SLIPS - 1]
                if found:
                    return found[0], TRUST[2]
            return low, 1.0
        letters = sum(c.isalpha() for c in low)
        if letters == 0 and not any(c in IMITATIONS for c in low):
            return low, 1.0
        masks = sum(c in MASKS for c in low)
        if not low[0].isalpha() and low[0] not in "$@" and not (low[0] in IMITATIONS and letters * 2 >= len(low)) or letters + sum(c in IMITATIONS for c in low) < 2:
            return low, 1.0
        short = _RUN.sub(r"\1\1\1", low) if masks == 0 else low
        if len(short) > self.longest:
            return low, 1.0
        found = [t for _, t in terms_within(self.trie, short, 0)]
        if not found and not masks:
            found = [t for s in (_RUN.sub(r"\1", low), _RUN.sub(r"\1\1", low)) for _, t in terms_within(self.trie, s, 0)]
        if not found and len(low) >= 7 and masks <= 1 and letters >= len(low) - 2:
            found = [t for _, t in terms_within(self.slip_trie, low, 1) if t[0] == low[0]]
        return (min(found, key=lambda t: -max(_NOUNS.get(x, 0) for x in self.role[t])), 1.0) if found else (low, 1.0)

    @staticmethod
    def inflected(word: str, term: str) -> bool:
        """Whether the word differs from the term by its last letter only, which makes it another word."""
        return word[:-1] == term or term[:-1] == word or word[:-1] == term[:-1]

    def read(self, chunk: str) -> Chunk:
        got = self.chunks.get(chunk)
        if got is None:
            core = chunk.strip(_EDGE)
            bang = core.rstrip("!")
            if core != bang and bang:
                core = bang.strip(_EDGE)
            low = fold(core)
            if low in self.known or low.isalpha():
                pairs = [self.restore_word(core)]
            elif _DOTTED.fullmatch(core):
                pairs = [self.restore_word(re.sub(r"[.\-_·•/,]", "", core))]
            else:
                whole = self.restore_word(core)
                if whole[0] in self.terms:
                    pairs = [whole]
                else:
                    pairs = [self.restore_word(p) for p in _WORD_PARTS.findall(core.replace("-", " ").replace("_", " ") if whole[0] == low else core)]
            pairs = [p for p in pairs if p[0]]
            first = next((c for c in core if c.isalpha()), "")
            stops = bool(_STOPS.search(chunk)) and len(core) > 1
            got = Chunk(tuple(p[0] for p in pairs), tuple(p[1] for p in pairs), first.isupper(), bool(_OPENS.match(chunk)), bool(_CLOSES.search(chunk)), stops, "!" in chunk[-3:], chunk.endswith(":"))
            if len(self.chunks) >= KEPT_WORDS:
                self.chunks.clear()
            self.chunks[chunk] = got
        return got

    def restore(self, chunk: str) -> str:
        """What a chunk between blanks says, as folded words."""
        return " ".join(self.read(chunk).words)

    def join_spaced(self, text: str) -> str:
        """Terms written with blanks between their letters, put together."""

        def put(m: re.Match) -> str:
            s = m[0].replace(" ", "")
            for cut in range(0, max(1, len(s) - 3)):
                for end in range(len(s), cut + 3, -1):
                    if end - cut <= self.longest and self.restore_word(s[cut:end])[0] in self.terms:
                        return " ".join([*s[:cut], s[cut:end], *([put_rest(s[end:])] if s[end:] else [])])
            return m[0]

        def put_rest(s: str) -> str:
            return s if s.lower() in self.known else " ".join(s)

        return _SPACED.sub(put, text)

    # texts

    def _mark(self, chunks: set[str]) -> set[str]:
        """The chunks that hold a word of weight."""
        hot = chunks & self.hot
        for c in chunks - self.plain - hot:
            if any(w in self.terms or w in self.starts for w in self.read(c).words):
                if len(self.hot) >= KEPT_WORDS:
                    self.hot.clear()
                self.hot.add(c)
                hot.add(c)
            else:
                if len(self.plain) >= KEPT_WORDS:
                    self.plain.clear()
                self.plain.add(c)
        return hot

    def passages(self, text: str) -> Iterator[tuple[dict[str, float], bool, str]]:
        """(weight per category, whether it is quoted, words) of each passage of a text."""
        if "-\n" in text or "-\r\n" in text:
            text = _HYPHEN_BREAK.sub("", text)
        if not text.isascii():
            for c in INVISIBLE:
                text = text.replace(chr(c), "") if chr(c) in text else text
        words = text.split()
        chunks = set(words)
        if sum(1 for c in chunks if len(c) == 1 and c.isalpha()) >= 3:
            joined = self.join_spaced(" ".join(words))
            words = joined.split()
            chunks = set(words)
        hot = self._mark(chunks)
        if not hot:
            return
        done = -1
        for i, c in enumerate(words):
            if i <= done or c not in hot:
                continue
            lo = i
            while lo > max(0, i - WINDOW) and not self._ends(words, lo - 1):
                lo -= 1
            hi, last = i, i
            while hi + 1 < len(words) and hi - last < WINDOW and not self._ends(words, hi):
                hi += 1
                if words[hi] in hot:
                    last = hi
            done = hi
            read = [self.read(x) for x in words[lo : hi + 1]]
            found = Passage(self, read, lo == 0 or self._ends(words, lo - 1)).score()
            if found:
                lead = words[max(0, i - 20) : i + 1]
                quoted = bool(_MARKS.search(" ".join(lead))) or any(w in self.saying for x in lead[-14:] for w in self.read(x).words)
                yield found, quoted, " ".join(words[lo : hi + 1])

    def _ends(self, words: list[str], i: int) -> bool:
        """Whether a sentence ends with this chunk."""
        return self.read(words[i]).stops and (i + 1 == len(words) or (words[i + 1].lstrip(_EDGE)[:1].isupper()) or not words[i + 1][0].isalnum())

    def score(self, text: str | None) -> tuple[float, float, float, str | None, int]:
        """(score, direct score, quoted score, category, number of hits) of a text.

        The score of a category is the sum of its passages of weight 1 or more, else the largest.
        """
        if not text:
            return 0.0, 0.0, 0.0, None, 0
        full: dict[str, float] = {}
        weak: dict[str, float] = {}
        by_use = [0.0, 0.0]
        n = 0
        for found, quoted, _ in self.passages(text):
            for category, weight in found.items():
                if weight >= THRESHOLD - 1e-9:
                    full[category] = full.get(category, 0.0) + weight
                    by_use[quoted] += weight
                    n += 1
                elif weight > 0:
                    weak[category] = max(weak.get(category, 0.0), weight)
        total = weak | full
        if not total:
            return 0.0, 0.0, 0.0, None, 0
        category = max(sorted(total), key=total.get)
        return round(total[category], 6), round(by_use[0], 6), round(by_use[1], 6), category, n


_SMALL = {k: frozenset(v) for k, v in lex.SMALL.items()}
_LEXICONS: dict[str, Lexicon] = {}


def lexicon(folder: str = VOCABULARIES) -> Lexicon:
    if folder not in _LEXICONS:
        _LEXICONS[folder] = Lexicon(folder)
    return _LEXICONS[folder]


def score_texts(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), directory: str = VOCABULARIES) -> DataFrame:
    """``keep`` columns with score, direct_score, quoted_score, category and n_hits of each whole text.

    A null or empty text scores 0 and has no category.  Repeated rows are scored
    each.  One pass without a shuffle; only ``keep`` and the text are read.
    directory: folder of the public vocabularies that tell ordinary words.
    """
    added = "score double, direct_score double, quoted_score double, category string, n_hits int"
    names = [x.split()[0] for x in added.split(", ")]
    if clash := set(keep) & set(names):
        raise ValueError(f"columns are in the way: {sorted(clash)}")
    taken = df.select(*keep, F.col(text).alias("__text"))
    schema = df.select(*keep, *(F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in added.split(", "))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lx = lexicon(directory)
        for b in batches:
            for i in range(0, max(b.num_rows, 1), 256):
                part = b.slice(i, 256)
                rows = [lx.score(t) for t in part.column(len(keep)).to_pylist()]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                made = [pa.array(c, t) for c, t in zip(cols, (pa.float64(), pa.float64(), pa.float64(), pa.string(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), *made], names=[*keep, *names])

    return taken.mapInArrow(run, schema)


def abusive_texts(df: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The ids of texts whose score reaches the threshold."""
    return score_texts(df, text, (id_col,)).filter(F.col("score") >= threshold).select(id_col)


def rates_by_source(scores: DataFrame, source: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """(source, n_texts, n_flagged, rate, n_direct, direct_rate, n_quoted, quoted_rate, mean_score, n_abusive, n_hateful, n_sexual).

    n_direct and n_quoted count flagged texts with a direct and with a quoted case;
    a text may have both.  A null source is a group of its own.
    """
    flagged = F.col("score") >= threshold
    direct, quoted = flagged & (F.col("direct_score") > 0), flagged & (F.col("quoted_score") > 0)
    return scores.groupBy(source).agg(
        F.count(F.lit(1)).alias("n_texts"), F.count_if(flagged).alias("n_flagged"), F.avg(flagged.cast("double")).alias("rate"),
        F.count_if(direct).alias("n_direct"), F.avg(direct.cast("double")).alias("direct_rate"), F.count_if(quoted).alias("n_quoted"), F.avg(quoted.cast("double")).alias("quoted_rate"),
        F.avg("score").alias("mean_score"), *(F.count_if(flagged & (F.col("category") == c)).alias(f"n_{c}") for c in ("abusive", "hateful", "sexual")),
    )
