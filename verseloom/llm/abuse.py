"""Scores for abusive, hateful or sexually explicit language.

Misspelled and disguised terms are caught by Levenshtein automata that run over a trie of the lexicon. Terms are then
weighed in context windows: words around them that mark a quotation, a report or a clinical or figurative use count
against abuse, words that address or threaten somebody count for it. The weights of terms and contexts are those of a
logistic model that is fitted, with the lexicon as its prior, to a bounded sample of hand labels.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verseloom.runtime import map_batches

#: The lexicon, common knowledge of each language, by kind; a line for each of English, German, French,
#: Spanish, Italian, Portuguese, Russian, and scripts without capitals.
LEXICON = {
    "insult": "idiot moron imbecile bastard scumbag asshole arsehole jackass dickhead dumbass shithead motherfucker twat wanker prick retard retarded scum stupid pathetic worthless loser coward liar filthy disgusting "
    "idiot vollidiot arschloch wichser schwachkopf trottel dreckskerl mistkerl schlampe versager hurensohn "
    "connard connasse salaud salope enculé crétin imbécile abruti ordure débile "
    "imbécil idiota cabrón gilipollas pendejo estúpido mierda hijoputa "
    "stronzo coglione bastardo cretino deficiente vaffanculo "
    "babaca otário canalha burro merda "
    "идиот дурак дебил урод мразь сволочь ублюдок тварь скотина гнида "
    "白痴 笨蛋 混蛋 傻逼 废物 人渣 馬鹿 バカ アホ クズ 死ね ゴミ غبي أحمق حقير كلب कुत्ता कमीना बेवकूफ गधा โง่ เหี้ย สัตว์",
    "sexual": "slut whore bitch cunt fuck fucking fucked cock dick pussy tits porn porno xxx horny orgasm blowjob handjob cum cumshot nude naked anal hardcore masturbate erection "
    "ficken fotze schwanz titten nackt geil "
    "baise baiser bite chatte pute nichons "
    "puta follar coño polla tetas "
    "cazzo figa troia scopare "
    "caralho buceta foda "
    "шлюха сука блядь хуй пизда ебать трахать голая "
    "色情 裸体 做爱 エロ セックス سكس شرموطة सेक्स เย็ด",
    "hate": "vermin subhuman subhumans parasites parasite cockroaches inferior savages infest deport exterminate "
    "ungeziefer untermensch untermenschen abschaum parasiten pack "
    "vermine racaille parasites sous-hommes "
    "alimañas escoria parásitos "
    "parassiti feccia vermes escória "
    "паразиты нелюди недочеловеки "
    "害虫 寄生虫 حشرات कीड़े",
    "threat": "kill murder shoot stab strangle slaughter hang burn smash throat "
    "umbringen töten erschießen abstechen "
    "tuer égorger buter "
    "matar degollar "
    "ammazzare uccidere matar "
    "убью убить зарежу прибью "
    "杀死 殺す اقتل",
}
#: Common words of reports, quotations for study, and clinical, legal and art writing, in the same languages.
CONTEXT = (
    "court judge tribunal lawsuit convicted sentenced police reported report according quote quoted quotes word term definition dictionary study studied research researchers survey paper corpus annotators codebook "
    "labelled moderation moderators banned policy patient patients diagnosis clinical medical surgeon anatomy examined novel painting sculpture museum gallery exhibition historian historians metaphor lecture archive "
    "gericht richter urteil laut bericht zitat wort begriff studie forschung patient klinisch museum roman "
    "tribunal juge jugement rapport selon citation mot terme étude recherche patient clinique musée roman "
    "juez sentencia informe según cita palabra término estudio paciente clínico museo novela "
    "tribunale giudice rapporto secondo citazione parola termine studio paziente clinico museo romanzo "
    "juiz relatório segundo citação palavra termo estudo paciente clínico museu romance "
    "суд судья согласно цитата слово термин исследование пациент клинический музей роман"
).split()
#: Look-alikes of Latin letters, and digits and signs written for letters.
LOOKALIKES = str.maketrans("авеікмнорсстухѕјԁԛԝαβεικνορτυχ", "abeikmhopcctyxsjdqwabeikvoptux")
LEET = str.maketrans("013457@$!|", "oieastasil")
#: Labelled documents that the model is fitted to, at most; which ones is decided by the hash of the id.
SAMPLE = 10_000
#: Words in a context window, and the step from one window to the next in a longer sentence.
WINDOW, STEP = 24, 8
#: Words whose reading is kept in a task.
CACHE = 200_000
SEED_WEIGHT, CONTEXT_WEIGHT = 3.0, -2.0
#: A label of abuse whose best window stays under this log odds after two rounds is taken for an error.
DOUBT = -0.5

_HIDDEN = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
_SPELLED = regex.compile(r"(?<![\p{L}\p{M}])\p{L}(?:([ .\-_*])\p{L}\p{M}*)(?:\1\p{L}\p{M}*)+(?![\p{L}\p{M}])")
_SENTENCE = re.compile(r"[\r\n]+|(?<=[.!?…])[\"”»’)]*\s+|(?<=[。！？।])")
_WORD = regex.compile(r"[\p{L}\p{M}][\p{L}\p{M}\p{N}@$*!|]*[\p{L}\p{M}\p{N}*$@]|[\p{L}]|\p{N}+[\p{L}@$*!|][\p{L}\p{N}@$*!|]*|\p{N}+")
# the same two for texts of ASCII characters only, in the faster module
_ASCII_SPELLED = re.compile(r"(?<![a-z])[a-z](?:([ .\-_*])[a-z])(?:\1[a-z])+(?![a-z])")
_ASCII_WORD = re.compile(r"[a-z][a-z0-9@$*!|]*[a-z0-9*$@]|[a-z]|[0-9]+[a-z@$*!|][a-z0-9@$*!|]*|[0-9]+")
_RUN = re.compile(r"(.)\1{2,}")
_MIXED = (regex.compile(r"[a-z]"), regex.compile(r"[\p{Cyrillic}\p{Greek}]"))
_UNCASED = regex.compile(r"[\p{Arabic}\p{Devanagari}]")
_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]")
_SIGN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]\p{M}*ー?|[^\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]+")


class LexiconTrie:
    """A trie of terms, searched with the Levenshtein automaton of a word; and a trie for each length of terms, as a word
    is only near terms of about its length."""

    def __init__(self, terms: dict[str, float]):
        self.terms = terms
        self.root: dict = {}
        self.of_length: dict[int, dict] = {}
        for t in terms:
            for root in (self.root, self.of_length.setdefault(len(t), {})):
                node = root
                for c in t:
                    node = node.setdefault(c, {})
                node[""] = t

    def near(self, word: str, errors: int) -> str | None:
        """The term within ``errors`` edits of ``word``, nearest first, then by weight. ``*`` stands for any one letter.

        The automaton's states are bits, one word of them for each number of errors; it goes down the trie letter by
        letter and turns back where no state is alive."""
        n = len(word)
        masks: dict[str, int] = {}
        anything = 0
        for i, c in enumerate(word):
            if c == "*":
                anything |= 1 << (i + 1)
            else:
                masks[c] = masks.get(c, 0) | 1 << (i + 1)
        if anything:
            masks = {c: m | anything for c, m in masks.items()}
        accept, best = 1 << n, None
        full = (1 << (n + 1)) - 1
        first = [(1 << (k + 1)) - 1 & full for k in range(errors + 1)]
        stack = [(self.of_length[size], first) for size in range(max(1, n - errors), n + errors + 1) if size in self.of_length]
        while stack:
            node, states = stack.pop()
            for c, below in node.items():
                if c == "":
                    for k, s in enumerate(states):
                        if s & accept:
                            found = (k, -self.terms[below], below)
                            best = found if best is None or found < best else best
                            break
                    continue
                m = masks.get(c, anything)
                s = states[0]
                new = (s << 1) & m
                after = [new]
                for k in range(1, errors + 1):
                    # a letter read, and one error more: replaced, inserted, or left out
                    t = states[k]
                    new = ((t << 1) & m | s | s << 1 | new << 1) & full
                    after.append(new)
                    s = t
                if new:
                    stack.append((below, after))
        return best[2] if best else None

    def split(self, letters: str) -> list[str] | None:
        """The letters as a row of terms, if they are one."""
        ways: dict[int, list[str]] = {0: []}
        for i in range(len(letters)):
            if i in ways:
                node = self.root
                for j in range(i, len(letters)):
                    node = node.get(letters[j])
                    if node is None:
                        break
                    if "" in node and j + 1 not in ways:
                        ways[j + 1] = [*ways[i], node[""]]
        return ways.get(len(letters))


def unmasked(text: str) -> str:
    """The text in lower case without hidden characters, and with letters that were spelled out put together."""
    if not text.isascii():
        for c in _HIDDEN:
            text = text.replace(c, "")
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    return (_ASCII_SPELLED if text.isascii() else _SPELLED).sub(lambda m: re.sub(r"[ .\-_*]", "", m.group()), text)


def raw_words(text: str) -> list[str]:
    return (_ASCII_WORD if text.isascii() else _WORD).findall(text)


class Reader:
    """Turns texts into windows of lexicon-aware words."""

    def __init__(self, trie: LexiconTrie, ordinary: frozenset[str]):
        self.trie, self.ordinary, self.seen = trie, ordinary, {}

    def _read(self, word: str) -> tuple[str, ...]:
        if word.isdigit():
            return ("0",)
        if word in self.trie.terms or word in self.ordinary:
            return (word,)
        if _UNSPACED.search(word):
            return tuple(self._signs(word))
        w = word
        if _MIXED[0].search(w) and _MIXED[1].search(w):
            w = w.translate(LOOKALIKES)
        if not w.isalpha() and w[0] not in "0123456789" or sum(c.isalpha() for c in w) > 1:
            w = w.translate(LEET) if any(not c.isalpha() and c != "*" for c in w) else w
        w = _RUN.sub(r"\1", w).strip("*") if "*" not in word else w
        if w in self.trie.terms or w in self.ordinary:
            return (w,)
        if _UNCASED.search(w):
            return (w,)
        if len(w) > 3 and (parts := self.trie.split(w)):
            return tuple(parts)
        if "*" in w:
            return (self.trie.near(w, 0) or w,) if sum(c != "*" for c in w) > 1 else (w,)
        if len(w) >= 4:
            found = self.trie.near(w, 2 if len(w) >= 9 else 1)
            # one letter of four is much: the first must be right, and no letter may be lost
            if found and (len(w) > 4 or (len(found) == 4 and found[0] == w[0])):
                return (found,)
        return (w,)

    def _signs(self, word: str) -> list[str]:
        """Scripts without spaces: the longest terms of the lexicon, else sign by sign."""
        out, at, signs = [], 0, _SIGN.findall(word)
        while at < len(signs):
            for n in range(min(6, len(signs) - at), 1, -1):
                if (term := "".join(signs[at : at + n])) in self.trie.terms:
                    out.append(term)
                    at += n
                    break
            else:
                out.append(signs[at])
                at += 1
        return out

    def read(self, word: str) -> tuple[str, ...]:
        r = self.seen.get(word)
        if r is None:
            if len(self.seen) > CACHE:
                self.seen.clear()
            r = self.seen[word] = self._read(word)
        return r

    def words(self, text: str) -> list[str]:
        return [x for w in raw_words(text) for x in self.read(w)]

    def sentences(self, text: str | None) -> list[list[str]]:
        """The words of each sentence that has any."""
        return [ws for x in _SENTENCE.split(unmasked(text or "")) if (ws := self.words(x))]

    def windows(self, text: str | None) -> list[list[str]]:
        """The text's sentences as words; a longer one as overlapping windows."""
        out = []
        for ws in self.sentences(text):
            out += [ws] if len(ws) <= WINDOW else [ws[i : i + WINDOW] for i in range(0, len(ws) - WINDOW + STEP, STEP)]
        return out


class Windows:
    """The windows of a batch of texts in arrays. Features of a window are its distinct words and pairs of neighbours."""

    def __init__(self, reader: Reader, texts: list[str | None], vocabulary: dict[str, int], grow: bool, cache: dict[str, tuple[int, ...]] | None = None):
        ids: list[int] = []
        sizes, docs = [], []
        cache = {} if cache is None else cache
        if len(cache) > CACHE:
            cache.clear()
        for d, text in enumerate(texts):
            for sentence in _SENTENCE.split(unmasked(text or "")):
                before = len(ids)
                for w in raw_words(sentence):
                    known = cache.get(w)
                    if known is None:
                        parts = reader.read(w)
                        known = cache[w] = tuple([vocabulary.setdefault(x, len(vocabulary)) for x in parts] if grow else [vocabulary.get(x, -1) for x in parts])
                    ids += known
                if len(ids) > before:
                    sizes.append(len(ids) - before)
                    docs.append(d)
        self.ids = np.array(ids, np.int64)
        size, doc = np.array(sizes, np.int64), np.array(docs, np.int64)
        self.sentence = np.repeat(np.arange(len(size)), size)
        self.doc_of = doc[self.sentence]
        follows = self.sentence[1:] == self.sentence[:-1]
        self.pairs = np.full(len(ids), -1, np.int64)
        known = follows & (self.ids[1:] >= 0) & (self.ids[:-1] >= 0)
        self.pairs[:-1][known] = self.ids[:-1][known] << 32 | self.ids[1:][known]
        per = np.where(size <= WINDOW, 1, -(-(size - WINDOW + STEP) // STEP))
        which = np.repeat(np.arange(len(size)), per)
        turn = np.arange(len(which)) - np.repeat(np.cumsum(per) - per, per)
        self.start = (np.cumsum(size) - size)[which] + turn * STEP
        self.length = np.minimum(WINDOW, size[which] - turn * STEP)
        self.doc = doc[which]
        self.word_before, self.pair_before = self._before(self.ids), self._before(self.pairs)

    def _before(self, keys: np.ndarray) -> np.ndarray:
        """The last position before in the same sentence with the same key, or -1."""
        order = np.lexsort((keys, self.sentence))  # stable: positions stay in order
        same = (keys[order][1:] == keys[order][:-1]) & (self.sentence[order][1:] == self.sentence[order][:-1])
        out = np.full(len(keys), -1, np.int64)
        out[order[1:][same]] = order[:-1][same]
        return out

    def _cells(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of the words of some windows, and whether a window's word, and the pair that begins there, is its first."""
        start = self.start[some][:, None]
        at = start + np.arange(WINDOW)
        inside = np.arange(WINDOW) < self.length[some][:, None]
        at[~inside] = 0
        pair = inside & (np.arange(WINDOW) < self.length[some][:, None] - 1)
        return at, inside & (self.word_before[at] < start), pair & (self.pair_before[at] < start)

    def logits(self, word_weights: np.ndarray, pair_weights: np.ndarray, bias: float) -> np.ndarray:
        """Of every window, from the weights at every position."""
        out = np.full(len(self.start), bias)
        for k in range(0, len(out), 50_000):
            at, word, pair = self._cells(np.arange(k, min(k + 50_000, len(out))))
            out[k : k + 50_000] += np.where(word, word_weights[at], 0.0).sum(axis=1) + np.where(pair, pair_weights[at], 0.0).sum(axis=1)
        return out

    def features(self, some: np.ndarray, pair_features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows (of ``some``) and features of the chosen windows."""
        at, word, pair = self._cells(some)
        rows = np.broadcast_to(np.arange(len(some))[:, None], at.shape)
        pair &= pair_features[at] >= 0
        return np.concatenate([rows[word], rows[pair]]), np.concatenate([self.ids[at[word]], pair_features[at[pair]]])


class AbuseModel:
    """The fitted weights. ``score`` of a text is the greatest score of its windows, between 0 and 1."""

    def __init__(self, reader: Reader, weights: dict[str, float], pairs: dict[tuple[str, str], float], bias: float):
        self.reader, self.bias, self.cache = reader, bias, {}
        known = dict.fromkeys([*weights, *reader.trie.terms, *(w for p in pairs for w in p)])
        self.vocabulary = {w: i for i, w in enumerate(known)}
        self.word_weights = np.array([*(weights.get(w, 0.0) for w in known), 0.0])  # the last is for unknown words
        self.is_term = np.array([*(w in reader.trie.terms for w in known), False])
        keys = np.array([self.vocabulary[a] << 32 | self.vocabulary[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], np.int64(-2))
        self.pair_weights = np.append(np.array(list(pairs.values()), float)[order], 0.0)

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The scores, and how many lexicon terms each text holds, disguised ones too."""
        w = Windows(self.reader, texts, self.vocabulary, False, self.cache)
        place = np.searchsorted(self.pair_keys[:-1], w.pairs)
        pair = np.where(self.pair_keys[place] == w.pairs, self.pair_weights[place], 0.0)
        best = np.full(len(texts), -30.0)
        np.maximum.at(best, w.doc, w.logits(self.word_weights[w.ids], pair, self.bias))
        hits = np.bincount(w.doc_of[self.is_term[w.ids]], minlength=len(texts))
        return 1 / (1 + np.exp(-best)), hits

    def score(self, text: str | None) -> tuple[float, int]:
        scores, hits = self.scores([text])
        return float(scores[0]), int(hits[0])


def _fit(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float = 0.5, steps: int = 200) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse 0/1 features, with weights drawn to ``prior``; plain accelerated gradient steps."""
    n, d = len(y), len(prior)
    w, b = prior.copy(), -2.0
    vw, vb = np.zeros(d), 0.0
    rate = 4.0 / max(1.0, np.bincount(rows, minlength=n).max() if len(rows) else 1.0)
    count = np.maximum(np.bincount(cols, minlength=d), 1)
    for _ in range(steps):
        z = np.bincount(rows, w[cols], minlength=n) + b
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        gw = np.bincount(cols, g[rows], minlength=d) + ridge * (w - prior)
        vw = 0.9 * vw - rate * gw / np.sqrt(count)
        vb = 0.9 * vb - rate * g.sum() / np.sqrt(n)
        w, b = w + vw, b + vb
    return w, float(b)


def fit_abuse_model(labelled: list[tuple[str | None, int]], rounds: int = 4, lexicon: dict[str, str] | None = None, context: Sequence[str] | None = None) -> AbuseModel:
    """Fit to ``(text, 0 or 1)``. Which window of an abusive text is the abusive one isn't labelled: each round takes the
    window that the model so far scores highest, and the three highest of other texts, and fits again. ``lexicon`` (terms by
    kind, parted by spaces) and ``context`` words take the place of the built-in ones."""
    seeds = {t: SEED_WEIGHT for terms in (LEXICON if lexicon is None else lexicon).values() for t in terms.split()}
    context = CONTEXT if context is None else context
    plain = Counter()
    for text, y in labelled:
        if not y:
            plain.update(set(raw_words(unmasked(text or ""))))
    ordinary = frozenset(w for w, n in plain.items() if n >= 3 and w.isalpha() and not _UNSPACED.search(w))
    reader = Reader(LexiconTrie(seeds), ordinary)
    vocabulary: dict[str, int] = {}
    w = Windows(reader, [t for t, _ in labelled], vocabulary, grow=True)
    y = np.array([bool(v) for _, v in labelled], bool)
    held = np.bincount(w.doc, minlength=len(y)) > 0
    n_bad, n_good = int((y & held).sum()), int((~y & held).sum())
    if not n_bad or not n_good:
        return AbuseModel(Reader(reader.trie, ordinary), {**seeds, **dict.fromkeys(context, CONTEXT_WEIGHT)}, {}, -4.0)
    pair_keys = np.unique(w.pairs[w.pairs >= 0])
    n_words = len(vocabulary)
    pair_features = np.where(w.pairs >= 0, np.searchsorted(pair_keys, w.pairs) + n_words, -1)
    total = n_words + len(pair_keys)
    # log odds of the documents that hold it: a first guess at every feature's weight
    present = np.sort(np.concatenate([w.doc_of * total + w.ids, (w.doc_of * total + pair_features)[pair_features >= 0]]))
    present = present[np.append(True, present[1:] != present[:-1])]
    in_bad = np.bincount(present % total, weights=y[present // total], minlength=total)
    in_good = np.bincount(present % total, minlength=total) - in_bad
    odds = np.log((in_bad + 0.3) / (n_bad + 1)) - np.log((in_good + 0.3) / (n_good + 1)) - 1
    weights = np.where(in_bad >= 2, np.clip(odds, -1.0, 3.0), 0.0)
    prior = np.zeros(total)
    is_seed = np.zeros(total, bool)
    for t in context:
        if t in vocabulary:
            prior[vocabulary[t]] = CONTEXT_WEIGHT
            weights[vocabulary[t]] = min(weights[vocabulary[t]], CONTEXT_WEIGHT)
    for t in seeds:
        if t in vocabulary:
            prior[vocabulary[t]] = SEED_WEIGHT
            is_seed[vocabulary[t]] = True
            weights[vocabulary[t]] = max(weights[vocabulary[t]], SEED_WEIGHT)
    bias = -3.0
    for turn in range(rounds):
        logit = w.logits(weights[w.ids], np.where(pair_features >= 0, weights[pair_features], 0.0), bias)
        order = np.lexsort((-logit, w.doc))
        first = np.concatenate([[True], w.doc[order][1:] != w.doc[order][:-1]])
        rank = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        abusive = y[w.doc[order]]
        keep = np.where(abusive, rank < 1, rank < 3)
        if turn > 1:  # an abusive text without an abusive window: most likely a wrong label
            keep &= ~abusive | (logit[order] >= DOUBT)
        chosen = order[keep]
        rows, features = w.features(chosen, pair_features)
        often = (np.bincount(features, minlength=total) >= 2) | is_seed
        rows, features = rows[often[features]], features[often[features]]
        names, cols = np.unique(features, return_inverse=True)
        fitted, bias = _fit(rows, cols, y[w.doc[chosen]].astype(float), prior[names])
        weights = np.where(is_seed, SEED_WEIGHT, 0.0)
        weights[names] = fitted
    word_of = list(vocabulary)
    kept = np.flatnonzero(np.abs(weights) > 0.01)
    words = {**seeds, **{word_of[k]: float(weights[k]) for k in kept if k < n_words}}
    ends = [(int(pair_keys[k - n_words]), float(weights[k])) for k in kept if k >= n_words]
    # the reader goes with what it has read, so that no task needs to look these words up again
    return AbuseModel(reader, words, {(word_of[k >> 32], word_of[k & 0xFFFFFFFF]): v for k, v in ends}, bias)


def save_abuse_model(spark: SparkSession, model: AbuseModel, path: str) -> None:
    """Write a fitted model to a folder, to score any number of tables by it."""
    spark.createDataFrame([(bytearray(cloudpickle.dumps(model)),)], "model binary").coalesce(1).write.mode("overwrite").parquet(path)


def load_abuse_model(spark: SparkSession, path: str) -> AbuseModel:
    """A model of :func:`save_abuse_model`. It is unpickled: only load what you trust."""
    return pickle.loads(spark.read.parquet(path).first().model)


def labelled_sample(docs: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_col: str, most: int = SAMPLE) -> list[tuple[str | None, int]]:
    """At most ``most`` labelled documents, by the hash of their id; null labels are left out, repeated ids count once."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("y"))
    picked = known.orderBy(F.xxhash64(id_col), id_col).limit(most)
    rows = docs.select(id_col, text_col).join(F.broadcast(picked), id_col).select(id_col, text_col, "y").collect()
    return [(r[1], r[2]) for r in sorted(rows, key=lambda r: r[0])]


def score_abuse(docs: DataFrame, id_col: str, text_col: str, model: AbuseModel, threshold: float = 0.4, keep: Sequence[str] = ()) -> DataFrame:
    """Every document's id, ``score`` (0 to 1), ``hits`` (lexicon terms it holds, disguised ones too) and ``flagged``, and
    the columns named in ``keep``.

    Whole texts, one row for each row of ``docs``, no shuffle. Null and empty texts score as having no windows, near 0; a
    null id stays null; repeated rows are each scored; other columns are ignored."""
    if set(keep) & {"score", "hits", "flagged", id_col}:
        raise ValueError("a column to keep has the name of a result")
    kinds = ", ".join(f"__k{n} {docs.schema[c].dataType.simpleString()}" for n, c in enumerate([id_col, *keep]))
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))

    def run(*columns: pa.Array, held={}):  # noqa: B006 - one model for all batches of a task
        if not held:
            held["model"] = pickle.loads(shared.value)
        scores, hits = held["model"].scores(columns[-1].to_pylist())
        yield {f"__k{n}": c for n, c in enumerate(columns[:-1])} | {"score": scores, "hits": hits, "flagged": scores >= threshold}

    picked = docs.select(*[F.col(f"`{c}`").alias(f"__k{n}") for n, c in enumerate([id_col, *keep])], F.col(f"`{text_col}`").cast("string").alias("__text"))
    return map_batches(picked, run, f"{kinds}, score double, hits int, flagged boolean").withColumnsRenamed({f"__k{n}": c for n, c in enumerate([id_col, *keep])})
