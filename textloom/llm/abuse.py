"""Scores for abusive, hateful and sexually explicit language.

Words are looked up by Levenshtein automata that run over a trie of the lexicon,
so that misspelt, masked and look-alike spellings reach their entry. Windows of
a few words are then scored by the entries they hold and by the words around
them, which tell speaking in one's own voice from quoting, reporting and
condemning. The weights are learned from hand labels on documents, starting
from those of the lexicon.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that the weights are learned from, at most about so many.
LABELLED = 12_000
#: Hashed features.
FEATURES = 1 << 17
#: Words of a window, and how far the next one starts after it.
WINDOW, STRIDE = 24, 12

#: Bytes of labelled texts that come to the driver, at most about so many.
LABELLED_BYTES = 256 << 20

#: The lexicon that learning starts from, by class: everyday words of several languages, none taken from a corpus.
LEXICON = {
    "insult": "idiot moron imbecile cretin dumbass dimwit halfwit nitwit fool scum scumbag bastard bitch asshole arsehole jerk loser prick dickhead cunt whore slut twat wanker worm parasite pig swine degenerate disgusting pathetic worthless filthy goddamn stupid dumb ugly rotten brainless spineless miserable coward trash schwein drecksau fresse abschaum wertlos wertloser erbärmlich erbärmlicher arschloch hurensohn wichser schlampe missgeburt connard connasse salope salaud enculé abruti imbécile gueule ordure pute putain idiota inútil imbécil estúpido asqueroso mierda cállate gilipollas cabrón puta escoria идиот дурак тварь мразь сволочь урод сука дебил ничтожество μαλάκας ηλίθιος βλάκας",
    "threat": "kill murder drown choke burn shoot die hang stab strangle verrecke umbringen erschießen crève crever pudras muérete ahorcarte сдохни убью умри",
    "hate": "vermin infest infested breed animals savages subhuman inferior exterminate deport cockroaches rats thieves dirty blood ungeziefer untermenschen ausrotten vermine cafards chasser plaga alimañas echarlos паразиты",
    "sexual": "porn porno naked nude nudes tits boobs cock pussy fuck fucked fucking horny sex xxx erection cum dick blowjob orgasm ficken nackt nackte titten geil baiser nu nue cul chatte follar follarte desnuda polla секс порно голая",
    "you": "you your yourself du dich dein tu te toi ton vous tú eres ti ты тебя",
    "distance": "report reports reported said quoted described according condemn condemns condemned insulted removed deleted moderator moderators clinic medical doctor patients health cancer education study research historian historians museum court trial police victims article film match",
}
#: What an entry of a class says before anything is learned.
PRIOR = {"insult": 1.5, "threat": 0.7, "hate": 1.0, "sexual": 1.5, "you": 0.4, "distance": -2.0}

#: Letters of other scripts, and signs, that stand for Latin letters.
LOOKS = str.maketrans("авеёікмнорстухѕјԁɡΑΒΕΖΗΙΚΜΝΟΡΤΥΧαορυνικ", "abeeikmhopctyxsjdgABEZHIKMNOPTYXaopuvik")
SIGNS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "€": "e", "|": "il"}
_TOKEN = re.compile(r"[^\W_]+(?:[*@$!|€’']+[^\W_]+)*[*$]*|[*@$]+[^\W_]+(?:[*@$!|]+[^\W_]+)*")
_BREAK = re.compile(r"[.!?。！？…]+[\"'”»)]*(?=\s|$|[^\x00-\x7f])|\n+")
_SPACED = [re.compile(rf"(?<![^\W_])(?:[^\W\d_]{sep}){{2,}}[^\W\d_](?![^\W_])") for sep in (r"\.", "-", "_", r"\*", "  ?")]
_LATIN, _OTHER = re.compile(r"[a-zA-Z]"), re.compile(r"[Ͱ-ӿԀ-ԯ]")


_JOINED = re.compile(r"(?<![^\W_])[^\W\d_](?:[.\-_*]| {1,2})[^\W\d_](?![^\W_])")
#: Combining marks and invisible characters, from their categories.
_DROPPED = {i: None for i in range(0x80, 0x1F000) if unicodedata.category(chr(i)) in ("Mn", "Cf")} | {i: None for i in range(0xE0000, 0xE01F0)}


def plain(text: str) -> str:
    """Compatibility forms, without invisible characters and marks, single letters set apart joined to words."""
    if not text.isascii():
        text = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text)).translate(_DROPPED)
    if _JOINED.search(text):
        for spaced in _SPACED:
            text = spaced.sub(lambda m: re.sub(r"[ .\-_*]", "", m[0]), text)
    return text


def windows(text: str) -> list[list[str]]:
    """The words of a text by sentence; long ones in overlapping windows."""
    out = []
    for sentence in _BREAK.split(plain(text)):
        found = _TOKEN.findall(sentence)
        if found:
            found = [_folded(w) for w in found]
            for i in range(0, max(1, len(found) - STRIDE), STRIDE) if len(found) > WINDOW else (0,):
                out.append(found[i : i + WINDOW])
    return out


_FOLDED: dict[str, str] = {}


def _folded(word: str) -> str:
    got = _FOLDED.get(word)
    if got is None:
        if len(_FOLDED) >= 200_000:
            _FOLDED.clear()
        got = _FOLDED[word] = _fold(word)
    return got


def _fold(word: str) -> str:
    if not word.isascii() and _LATIN.search(word) and _OTHER.search(word):
        word = word.translate(LOOKS)
    word = word.lower()
    return re.sub(r"(.)\1{2,}", r"\1\1", word) if len(word) > 3 else word


class Trie:
    """The lexicon as nested dictionaries; the empty key holds the entry."""

    def __init__(self, entries: Iterable[str]) -> None:
        self.root: dict = {}
        for entry in entries:
            node = self.root
            for c in entry:
                node = node.setdefault(c, {})
            node[""] = entry


class Automaton:
    """Accepts the words within ``edits`` of a pattern; a mask takes any letter, a sign any letter that it stands for.

    A state is one bit set for each number of edits: bit i says that the first i
    letters of the pattern can have been read with so many edits.
    """

    def __init__(self, word: str, edits: int) -> None:
        self.n, self.edits = len(word), edits
        self.end = 1 << self.n
        self.takes: dict[str, int] = {}
        self.any = 0
        for i, c in enumerate(word):
            if c == "*":
                self.any |= 1 << i
            for letter in c + SIGNS.get(c, ""):
                self.takes[letter] = self.takes.get(letter, 0) | 1 << i

    def start(self) -> tuple[int, ...]:
        return tuple((1 << (e + 1)) - 1 for e in range(self.edits + 1))

    def step(self, state: tuple[int, ...], letter: str) -> tuple[int, ...]:
        fits = self.takes.get(letter, 0) | self.any
        out = [(state[0] & fits) << 1]
        for e in range(1, self.edits + 1):
            before = state[e - 1]
            out.append((state[e] & fits) << 1 | before << 1 | before | out[e - 1] << 1)
        return tuple(out)

    def cost(self, state: tuple[int, ...]) -> int | None:
        return next((e for e, bits in enumerate(state) if bits & self.end), None)

    def search(self, trie: Trie) -> str | None:
        """The entry with the fewest edits, the first in order among equals."""
        best: tuple[int, str] | None = None
        stack = [(trie.root, self.start())]
        within = (self.end << 1) - 1
        step = self.step
        while stack:
            node, state = stack.pop()
            for letter, below in node.items():
                if not letter:
                    if (c := self.cost(state)) is not None and (best is None or (c, below) < best):
                        best = (c, below)
                    continue
                new = step(state, letter)
                if new[-1] & within:
                    stack.append((below, new))
        return best[1] if best else None


def _letters(word: str) -> int:
    """The letters of a word as bits; signs, which may stand for any, leave none."""
    bits = 0
    for c in word:
        if c.isalpha():
            bits |= 1 << (ord(c) & 63)
    return bits


class Reader:
    """Words to lexicon entries, with those looked up before kept, up to ``keep`` of them."""

    def __init__(self, entries: Iterable[str], common: Iterable[str] = (), keep: int = 200_000) -> None:
        self.entries = set(entries)
        self.common = set(common) - self.entries
        self.trie = Trie(sorted(self.entries))
        self.shorter = self.entries | {e[:i] + e[i + 1 :] for e in self.entries for i in range(len(e))}
        self.letters: dict[int, set[int]] = {}
        for e in self.entries:
            self.letters.setdefault(len(e), set()).add(_letters(e))
        self.keep = keep
        self.known: dict[str, str] = {}
        self.parts: dict[str, list[str]] = {}
        self.grams: dict[str | tuple[str, ...], int] = {}
        self.scores: dict[tuple[str, ...], float] = {}

    def word(self, w: str) -> str:
        """The entry a word stands for; itself if it is an ordinary word, else a place holder."""
        got = self.known.get(w)
        if got is None:
            if len(self.known) >= self.keep:
                self.known.clear()
            got = self.known[w] = self._look(w)
        return got

    def _within(self, w: str, edits: int) -> str | None:
        """The entry within so many edits, by the automaton of the word over the trie.

        Most words are told apart from all entries before: one edit leaves them and
        an entry a common form with one letter less at most, and every letter
        that an entry lacks takes an edit of its own.
        """
        if edits == 1 and w.isalpha():
            if w not in self.shorter and not any(w[:i] + w[i + 1 :] in self.shorter for i in range(len(w))):
                return None
        else:
            own = _letters(w)
            if not any((own & ~x).bit_count() <= edits for n in range(len(w) - edits, len(w) + edits + 1) for x in self.letters.get(n, ())):
                return None
        return Automaton(w, edits).search(self.trie)

    def _look(self, w: str) -> str:
        if w in self.entries or w in self.common:
            return w
        if w.isdigit():
            return "#"
        odd = not w.isalpha()
        if len(w) < 4 and not odd or len(w) > 40:
            return "?"
        short = re.sub(r"(.)\1+$", r"\1", w)
        if short in self.entries or short in self.common:
            return short
        for i in range(len(w) - 1):  # two letters that changed places
            if (swapped := w[:i] + w[i + 1] + w[i] + w[i + 2 :]) in self.entries:
                return swapped
        found = self._within(w, 0) if odd else None
        if found is None and len(w) > 3:
            found = self._within(w, 1)
        if found is None and short != w and len(short) > 3:
            found = self._within(short, 1)
        if found is None and odd and len(w) > 7:
            found = self._within(w, 2)
        return found or "?"

    def _split(self, w: str) -> list[str]:
        """Words written as one, of which one at least is an entry, as few as possible; else the place holder.

        Entries of three letters or more and ordinary words may follow each other
        in any number; a letter or two beside a longer one may be what is left of a run of set-apart letters.
        """
        n = len(w)
        if n < 7:
            return ["?"]
        # by place: the fewest parts up to it, without and with an entry among them, and where the last part starts
        best: list[list[tuple[int, int, bool] | None]] = [[None, None] for _ in range(n + 1)]
        best[0][0] = (0, 0, False)
        for i in range(n):
            for had in (0, 1):
                if (here := best[i][had]) is None:
                    continue
                for j in range(i + 1, min(n, i + 24) + 1):
                    part = w[i:j]
                    entry = j - i > 2 and part in self.entries
                    if not entry and not (j - i > 2 and part in self.common) and j - i > 1:
                        continue
                    now = 1 if entry or had else 0
                    cost = here[0] + (1 if j - i > 2 else 3)
                    if best[j][now] is None or cost < best[j][now][0]:
                        best[j][now] = (cost, i, bool(had))
        end = best[n][1]
        if end is None:
            return ["?"]
        out, at, had = [], n, 1
        while at:
            _, i, before = best[at][had]
            out.append(w[i:at])
            at, had = i, int(before)
        stray = sum(len(x) < 3 for x in out)
        if end[0] > 2 + n // 6 and (stray > 2 or max(map(len, out)) < 5):
            return ["?"]
        return [x if len(x) > 2 else "?" for x in reversed(out)]

    def _parts(self, w: str) -> list[str]:
        got = self.parts.get(w)
        if got is None:
            if len(self.parts) >= self.keep:
                self.parts.clear()
            found = self.word(w)
            got = self.parts[w] = self._split(w) if found == "?" else [found]
        return got

    def gram(self, key: tuple[str, ...]) -> int:
        """The place of a word, pair or triple among the hashed features."""
        got = self.grams.get(key)
        if got is None:
            if len(self.grams) >= 5 * self.keep:
                self.grams.clear()
            got = self.grams[key] = xxhash.xxh3_64_intdigest(" ".join(key)) % (FEATURES - 64)
        return got

    def read(self, window: list[str]) -> list[str]:
        """Entries and ordinary words of a window; halves of an entry are joined."""
        out: list[str] = []
        i, n = 0, len(window)
        while i < n:
            if i + 1 < n:
                both = window[i] + window[i + 1]
                if both in self.entries and not (window[i] in self.common and window[i + 1] in self.common) and window[i] not in self.entries:
                    out.append(both)
                    i += 2
                    continue
            out += self._parts(window[i])
            i += 1
        return out


def _classes() -> dict[str, str]:
    out: dict[str, str] = {}
    for name, entries in LEXICON.items():
        for entry in entries.split():
            out.setdefault(_fold(plain(entry)), name)
    return out


CLASSES = _classes()
CLASS_NAMES = sorted(LEXICON)


def features(read: list[str], reader: Reader) -> set[int]:
    """Hashed words, pairs and triples of a window and the classes of its entries; place holders only within pairs and triples."""
    gram = reader.gram
    out = {gram((w,)) for w in read if w not in "?#"}
    known = [w not in "?#" for w in read]
    for i in range(len(read) - 1):
        if known[i] or known[i + 1]:
            out.add(gram((read[i], read[i + 1])))
            if i + 2 < len(read) and known[i] + known[i + 1] + known[i + 2] > 1:
                out.add(gram((read[i], read[i + 1], read[i + 2])))
    held = Counter([CLASSES[w] for w in {*read} if w in CLASSES])
    for c, n in held.items():
        at = CLASS_NAMES.index(c)
        out.add(FEATURES - 64 + at)
        if n > 1:
            out.add(FEATURES - 48 + at)
    if "you" in held and ("insult" in held or "threat" in held):
        out.add(FEATURES - 32)
    return out


def prior_weights() -> np.ndarray:
    w = np.zeros(FEATURES, np.float32)
    for i, name in enumerate(CLASS_NAMES):
        w[FEATURES - 64 + i] = PRIOR[name]
        w[FEATURES - 48 + i] = PRIOR[name]
    return w


class Model:
    """What scoring needs: lexicon entries, ordinary words, weights, a constant and a threshold."""

    def __init__(self, entries: set[str], common: set[str], weights: np.ndarray, bias: float, threshold: float) -> None:
        self.entries, self.common, self.weights, self.bias, self.threshold = entries, common, weights, bias, threshold
        self.listed: list[float] = []

    def reader(self) -> Reader:
        self.listed = self.weights.tolist()
        return Reader(self.entries, self.common)

    def score(self, reader: Reader, text: str | None) -> tuple[float, list[str]]:
        """The score of a text, that of its worst window, and that window's words; -inf for a text without words."""
        best, words = -np.inf, []
        for window in windows(text) if text else ():
            read = reader.read(window)
            name = tuple(read)
            s = reader.scores.get(name)
            if s is None:
                if len(reader.scores) >= reader.keep:
                    reader.scores.clear()
                weights = self.listed
                s = reader.scores[name] = sum([weights[i] for i in features(read, reader)]) + self.bias
            if s > best:
                best, words = s, read
        return best, words


def learn(labelled: list[tuple[str, int]], rounds: int = 3, epochs: int = 5, seed: int = 0) -> Model:
    """Weights from texts with a label 0 or 1; the lexicon's own where there are too few labels.

    A text is toxic if one of its windows is, so in each round the worst window
    of each toxic text and all windows of the others are what is learned from.
    Words that mostly come in toxic texts join the lexicon.
    """
    cut = [(windows(t), y) for t, y in labelled if t]
    seen, toxic = Counter(), Counter()
    for w, y in cut:
        distinct = {x for window in w for x in window}
        seen.update(distinct)
        if y:
            toxic.update(distinct)
    share = max(1, sum(y for _, y in cut)) / max(1, len(cut))
    common = {x for x, n in seen.items() if n >= max(3, len(cut) // 400) and x.isalpha()}
    learned = {x for x, n in toxic.items() if n >= 3 and x.isalpha() and len(x) > 2 and n / seen[x] > min(0.9, 3 * share)}
    entries = set(CLASSES) | learned
    reader = Reader(entries, common)
    rows: list[np.ndarray] = []
    number: dict[bytes, int] = {}
    kind: list[int] = []
    owner: list[int] = []
    for i, (w, _) in enumerate(cut):
        for window in w:
            f = np.array(sorted(features(reader.read(window), reader)), np.int64)
            name = f.tobytes()
            if name not in number:
                number[name] = len(rows)
                rows.append(f)
            kind.append(number[name])
            owner.append(i)
    bias = -2.5
    y = np.array([y for _, y in cut], np.int64)
    if not len(rows) or not y.any() or y.all():
        return Model(entries, common, prior_weights(), bias, 0.0)
    own, of = np.array(owner, np.int64), np.array(kind, np.int64)
    length = np.array([len(r) for r in rows], np.int64)
    starts = np.cumsum(length) - length
    flat = np.concatenate(rows)
    row_of = np.repeat(np.arange(len(rows)), length)
    anchor = prior_weights()
    weights = anchor.copy()
    random = np.random.RandomState(seed)

    def summed(values: np.ndarray) -> np.ndarray:
        return np.bincount(row_of, weights=values[flat], minlength=len(rows))

    def of_texts(s: np.ndarray) -> np.ndarray:
        out = np.full(len(cut), -np.inf)
        np.maximum.at(out, own, s[of])
        return out

    # before anything is learned: how much more often a window's features come in toxic texts
    pairs = np.unique(of * len(cut) + own)
    n_toxic = np.bincount(pairs // len(cut), weights=y[pairs % len(cut)], minlength=len(rows))
    n_any = np.bincount(pairs // len(cut), minlength=len(rows))
    in_toxic = np.bincount(flat, weights=n_toxic[row_of], minlength=FEATURES)
    in_any = np.bincount(flat, weights=n_any[row_of], minlength=FEATURES)
    lift = np.log((in_toxic + 0.5 * share) / (in_any - in_toxic + 0.5 * (1 - share))) - np.log(share / (1 - share))
    guess = summed(np.maximum(lift, 0)) / np.sqrt(np.maximum(length, 1)) + (summed(weights) + bias) * 0.5
    # labels that the words contradict: toxic texts of ordinary windows only, others with a window seen mostly in toxic ones
    mean = np.maximum(length, 1)
    novel = summed(in_toxic > 0.5 * in_any) / mean
    usual = summed((in_toxic > 0.8 * in_any) & (in_any >= 5)) / mean
    doubtful = np.where(y == 1, of_texts(novel) < 0.35, of_texts(usual) > 0.5)
    sure = ~doubtful[own]
    clean = np.bincount(of[(y[own] == 0) & sure], minlength=len(rows))
    rest = np.flatnonzero(clean)
    for _ in range(rounds):
        top = of_texts(guess)
        at = np.flatnonzero((guess[of] == top[own]) & (y[own] == 1) & sure)
        best = of[at[np.unique(own[at], return_index=True)[1]]]
        pick, label = np.concatenate([best, rest]), np.concatenate([np.ones(len(best)), np.zeros(len(rest))])
        gain = np.where(label == 1, 4.0, np.minimum(clean[pick], 20))
        weights, bias = anchor.copy(), -2.5
        memory = np.full(FEATURES, 1e-2, np.float32)
        for _ in range(epochs):
            order = random.permutation(len(pick))
            for i in range(0, len(order), 256):
                part = order[i : i + 256]
                r = pick[part]
                idx = np.repeat(np.arange(len(r)), length[r])
                f = flat[np.repeat(starts[r], length[r]) + np.arange(len(idx)) - np.repeat(np.cumsum(length[r]) - length[r], length[r])]
                s = np.bincount(idx, weights=weights[f], minlength=len(r)) + bias
                g = (1 / (1 + np.exp(-np.clip(s, -30, 30))) - label[part]) * gain[part]
                grad = np.bincount(f, weights=g[idx], minlength=FEATURES).astype(np.float32) / len(r)
                hit = np.flatnonzero(grad)
                grad[hit] += 2e-4 * (weights[hit] - anchor[hit])
                memory[hit] += grad[hit] ** 2
                weights[hit] -= 0.3 * grad[hit] / np.sqrt(memory[hit])
                bias -= 0.1 * float(g.mean())
        guess = summed(weights) + bias
    total, y = of_texts(guess)[~doubtful], y[~doubtful]
    order = np.argsort(-total, kind="stable")
    right = np.cumsum(y[order])
    f1 = 2 * right / (np.arange(1, len(order) + 1) + y.sum())
    k = int(np.argmax(f1))
    after = max(total[order[k + 1]], -10.0) if k + 1 < len(order) else -10.0
    # the middle of the gap below the last of the best, but not far from even odds
    return Model(entries, common, weights, bias, float(np.clip((total[order[k]] + after) / 2, -1, 0)))


def labelled_texts(documents: DataFrame, key: str, text: str, labels: DataFrame, label: str, most: int = LABELLED, most_bytes: int = LABELLED_BYTES, within: Column | None = None) -> list[tuple[str, int]]:
    """At most about ``most`` labelled texts of ``most_bytes``, chosen by hash; of several labels the majority, a tie being left out.

    ``within`` may say which of the labelled rows count, by a condition on ``key``.

    Pending labels and null texts don't count.
    """
    rows = labelled_rows(documents, key, text, labels, label)
    if within is not None:
        rows = rows.where(within)
    n, held = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    share = min(1.0, most / max(1, n), most_bytes / max(1, held))
    got = rows.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < F.lit(share * (1 << 20))).collect()
    return [(r["text"], r["y"]) for r in sorted(got, key=lambda r: r["key"])]


def labelled_rows(documents: DataFrame, key: str, text: str, labels: DataFrame, label: str) -> DataFrame:
    """``key, text, y`` of the documents with a label."""
    votes = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("key")).agg(F.avg(label).alias("mean")).where("mean <> 0.5")
    rows = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where("text is not null")
    return rows.join(votes, "key").select("key", "text", (F.col("mean") > 0.5).cast("int").alias("y"))


def scored(documents: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """``key, score, toxic, window``: every document's score, whether it reaches the threshold, and its worst window.

    Null, empty and wordless texts have a null score and aren't toxic. Whole
    texts are scored; rows stay where they are read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        reader = own.reader()
        for batch in batches:
            found = [own.score(reader, t) for t in batch.column(1).to_pylist()]
            score = [None if s == -np.inf else s for s, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array([s >= own.threshold for s, _ in found], pa.bool_()), pa.array([" ".join(w) for _, w in found], pa.string())], names=[key, "score", "toxic", "window"])

    rows = documents.select(F.col(key), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(marked, f"`{key}` {rows.schema[0].dataType.simpleString()}, score double, toxic boolean, window string")
