"""Missing or wrong document language labels.

Hierarchical discrimination: linear support vector machines on character n-grams tell the family of a sentence first,
then one-versus-one machines separate the languages within it. They are trained on a bounded sample of the labelled
documents themselves, twice: sentences that the first fit contradicts are left out of the second, as labels may be
wrong. Classification is by sentence; sentences of one language in a row make a segment.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Languages by family.
FAMILIES = {"germanic": ("en", "de", "nl"), "romance": ("fr", "es", "pt", "it"), "slavic": ("ru",)}
LANGUAGES = tuple(x for f in FAMILIES.values() for x in f)

#: Usual codes and names of the languages, in lower case; a region or script may follow a code.
NAMES = {
    "en": "en eng english englisch anglais inglés ingles inglês inglese engels английский",
    "de": "de deu ger german deutsch allemand alemán aleman alemão alemao tedesco duits немецкий",
    "nl": "nl nld dut dutch nederlands niederländisch néerlandais neerlandés holandés holandês olandese flemish vlaams нидерландский голландский",
    "fr": "fr fra fre french français francais französisch francés frances francês francese frans французский",
    "es": "es spa spanish español espanol castellano castilian spanisch espagnol espanhol spagnolo spaans испанский",
    "pt": "pt por portuguese português portugues portugiesisch portugais portugués portoghese portugees португальский",
    "it": "it ita italian italiano italienisch italien italiaans итальянский",
    "ru": "ru rus russian русский russisch russe ruso russo",
}

#: Bounds of the training sample: documents of each language, characters of each that are read, sentences of each language.
SAMPLE_DOCUMENTS, SAMPLE_CHARS, SAMPLE_SENTENCES = 200, 20_000, 500
#: Features are hashed n-grams of two and three characters.
BITS, ORDERS = 15, (2, 3)
#: Characters that are classified at once.
CHUNK = 400_000
#: A sentence needs so many letters to train on; a text without one as long is classified whole. A sentence needs so sure
#: a call to stand alone against the rest of its text.
LETTERS, SURE = 12, 0.55

_SENTENCE = re.compile(r"(?<=[.!?…])[\"'»“”’)\]]*\s+|\n+")
_NOT_WORDS = re.compile(r"<[^<>\n]*>|(?<!\S)\S*[\d/_@\\]\S*|&[a-z]+;")
_NOT_LETTERS = re.compile(r"[^\w\n']+")
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def label_language(label: Column | str) -> Column:
    """The language that a label names, as one of LANGUAGES; null if it names none of them."""
    c = F.lower(F.trim(F.col(label) if isinstance(label, str) else label))
    c = F.trim(F.regexp_replace(c, r"\(.*\)", ""))
    known = F.create_map(*(F.lit(x) for lang, names in NAMES.items() for n in names.split() for x in (n, lang)))
    code = F.regexp_extract(c, r"^([a-z]{2,3})[-_][a-z0-9\-_@.]+$", 1)
    return F.coalesce(F.try_element_at(known, c), F.try_element_at(known, code))


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text; what lies between them is white space or closing marks."""
    out, at = [], 0
    for m in _SENTENCE.finditer(text):
        if text[at : m.start()].strip():
            out.append((at, m.start()))
        at = m.end()
    if text[at:].strip():
        out.append((at, len(text)))
    return out


def _clean(texts: list[str]) -> str:
    joined = "\n".join(t.replace("\n", " ") for t in texts).lower()
    return _NOT_LETTERS.sub(" ", _NOT_WORDS.sub(" ", joined))


def _ngrams(texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """(feature, text number) of the n-grams of each order, in the order of the texts, and the letters of each text."""
    c = np.frombuffer((" " + _clean(texts).replace("\n", " \n ") + " ").encode("utf-32-le"), np.uint32)
    stop = c == 10
    text = np.cumsum(stop)
    letters = np.bincount(text[(c != 10) & (c != 32)], minlength=len(texts))[: len(texts)]
    out = []
    h = np.zeros(len(c), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        h = h[: len(c) - n + 1] * np.uint32(31) + c[n - 1 :] * _MIX[n - 1]
        if n not in ORDERS:
            continue
        same = ~stop[n - 1 :] & (text[: len(c) - n + 1] == text[n - 1 :]) & ~stop[: len(c) - n + 1]
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out.append(((mixed[same] >> np.uint32(32 - BITS)).astype(np.int32), text[: len(c) - n + 1][same].astype(np.int32)))
    return out, letters


def _svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, c: float = 1.0, epochs: int = 12) -> np.ndarray:
    """A linear support vector machine by dual coordinate descent; rows are (features, values) of unit length."""
    w, alpha, order = np.zeros(1 << BITS, np.float32), np.zeros(len(rows)), np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            f, v = rows[i]
            if not len(f):
                continue
            new = min(max(alpha[i] - (y[i] * float(w[f] @ v) - 1.0), 0.0), c)
            if new != alpha[i]:
                w[f] += (new - alpha[i]) * y[i] * v
                alpha[i] = new
    return w


@dataclass
class Model:
    """weights: machines x features; pairs: the languages or families that each tells apart (positive, negative)."""

    weights: np.ndarray
    pairs: list[tuple[str, str]]

    def classify(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Language number in LANGUAGES (-1: no letters) and confidence of each text."""
        return self.measured(texts)[:2]

    def measured(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number in LANGUAGES (-1: no letters), confidence and letters of each text."""
        langs, sure, letters = [], [], []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) < CHUNK):
                size += len(texts[end]) + 1
                end += 1
            for found, x in zip((langs, sure, letters), self._classify(texts[at:end])):
                found.append(x)
            at = end
        return (np.concatenate(langs), np.concatenate(sure), np.concatenate(letters)) if langs else (np.zeros(0, int), np.zeros(0), np.zeros(0, int))

    def _classify(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        grams, letters = _ngrams(texts)
        n = len(texts)
        by_feature = np.ascontiguousarray(self.weights.T)
        sums, count = np.zeros((n, len(self.pairs))), np.zeros(n)
        for f, owner in grams:
            if len(f):
                first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                sums[owner[first]] += np.add.reduceat(by_feature[f], first, axis=0)
                count += np.bincount(owner, minlength=n)
        # Sums of squared counts would need the counts of each feature; the root of the number of n-grams does as well.
        sums /= np.sqrt(np.maximum(1, count))[:, None]
        margin = {p: sums[:, k] for k, p in enumerate(self.pairs)}
        names = list(FAMILIES)
        family = np.stack([margin[(x, "rest")] for x in names])
        best = family.argmax(axis=0)
        lang, sure = np.full(n, -1), np.zeros(n)
        second = np.sort(family, axis=0)[-2]
        for k, x in enumerate(names):
            mine = best == k
            if not mine.any():
                continue
            members = FAMILIES[x]
            votes = np.zeros((len(members), n))
            worst = np.full((len(members), n), np.inf)
            for i, j in combinations(range(len(members)), 2):
                m = margin[(members[i], members[j])]
                votes[i] += m > 0
                votes[j] += m <= 0
                worst[i], worst[j] = np.minimum(worst[i], m), np.minimum(worst[j], -m)
            total = votes + np.tanh(np.where(np.isinf(worst), 0, worst)) / 4  # among equal votes the larger least margin
            won = total.argmax(axis=0)
            least = np.minimum(np.take_along_axis(worst, won[None], 0)[0], family[k] - second)
            lang[mine] = np.array([LANGUAGES.index(m) for m in members])[won[mine]]
            sure[mine] = 1 / (1 + np.exp(-3 * least[mine]))
        lang[letters < 1] = -1
        return lang, sure, letters


def fit(texts: list[str], labels: list[str]) -> Model:
    """Fits the machines to labelled sentences, then again without those that the first fit contradicts."""
    y = np.array([LANGUAGES.index(x) for x in labels])
    model = _fit(texts, y)
    lang, _, letters = model.measured(texts)
    keep = (lang == y) & (letters >= LETTERS)
    # A language whose sentences were all contradicted keeps them.
    for k in range(len(LANGUAGES)):
        if not keep[y == k].any():
            keep |= y == k
    return _fit([t for t, k in zip(texts, keep) if k], y[keep])


def _fit(texts: list[str], y: np.ndarray) -> Model:
    grams, _ = _ngrams(texts)
    f, owner = (np.concatenate(x) for x in zip(*grams))
    order = np.argsort(owner, kind="stable")
    f, ends = f[order], np.cumsum(np.bincount(owner, minlength=len(texts)))
    rows = []
    for a, b in zip([0, *ends[:-1]], ends):
        u, n = np.unique(f[a:b], return_counts=True)
        rows.append((u, (n / max(1.0, np.sqrt(b - a))).astype(np.float32)))
    of = {x: fam for fam, langs in FAMILIES.items() for x in langs}
    fam = np.array([of[LANGUAGES[k]] for k in y])
    pairs, weights = [], []
    for x in FAMILIES:
        pairs.append((x, "rest"))
        weights.append(_svm(rows, np.where(fam == x, 1.0, -1.0)))
    for langs in FAMILIES.values():
        for a, b in combinations(langs, 2):
            i, j = LANGUAGES.index(a), LANGUAGES.index(b)
            use = np.flatnonzero((y == i) | (y == j))
            pairs.append((a, b))
            weights.append(_svm([rows[k] for k in use], np.where(y[use] == i, 1.0, -1.0)))
    return Model(np.stack(weights), pairs)


def training_sample(documents: DataFrame, text: str = "text", label: str = "lang") -> tuple[list[str], list[str]]:
    """Sentences and labels of a bounded sample: SAMPLE_DOCUMENTS documents of each language by the hash of their
    text, SAMPLE_CHARS of each, SAMPLE_SENTENCES of each language."""
    d = documents.select(F.substring(text, 1, SAMPLE_CHARS).alias("text"), label_language(label).alias("lang")).where("lang is not null and length(trim(text)) > 0")
    w = Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text")
    rows = d.withColumn("n", F.row_number().over(w)).where(F.col("n") <= SAMPLE_DOCUMENTS).orderBy("lang", "n").select("text", "lang").collect()
    texts, labels, count = [], [], dict.fromkeys(LANGUAGES, 0)
    for r in rows:
        for a, b in sentences(r["text"]):
            if count[r["lang"]] < SAMPLE_SENTENCES and b - a >= LETTERS:
                count[r["lang"]] += 1
                texts.append(r["text"][a:b])
                labels.append(r["lang"])
    return texts, labels


def segments(documents: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, segment from 0, start, length, lang, sentences, confidence): runs of sentences of one language, in
    characters of the text. Sentences without letters, or whose language is unsure and occurs but once, go with the
    language that most of the text has; in texts whose sentences are all of fewer than LETTERS letters the unsure ones
    go with the language of the whole. Null and empty texts, and those without letters, have no segments."""
    weights, pairs = model.weights, model.pairs

    def run(batches):
        m = Model(weights, pairs)
        for pdf in batches:
            texts, spans, owners = [], [], []
            for k, t in enumerate(pdf["text"]):
                for a, b in sentences(t) if isinstance(t, str) else ():
                    texts.append(t[a:b])
                    spans.append((a, b))
                    owners.append(k)
            lang, sure, letters = m.measured(texts)
            _by_whole(m, pdf["text"], owners, lang, sure, letters)
            yield pd.DataFrame(_runs(pdf["doc_id"].tolist(), owners, spans, lang, sure), columns=["doc_id", "segment", "start", "length", "lang", "sentences", "confidence"])

    kind = dict(documents.dtypes)[doc_id]
    d = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return d.mapInPandas(run, f"doc_id {kind}, segment int, start int, length int, lang string, sentences int, confidence double")


def _by_whole(m: Model, texts, owners, lang: np.ndarray, sure: np.ndarray, letters: np.ndarray) -> None:
    """Gives unsure sentences of texts without a long one the language and confidence of the whole text."""
    owner = np.array(owners, int)
    whole = np.setdiff1d(owner[lang >= 0], owner[letters >= LETTERS])
    if len(whole):
        found, how = m.classify([texts.iloc[k] for k in whole])
        at = np.minimum(np.searchsorted(whole, owner), len(whole) - 1)
        mine = (whole[at] == owner) & (lang >= 0) & (sure < SURE) & (found[at] >= 0)
        lang[mine], sure[mine] = found[at][mine], how[at][mine]


def _runs(ids, owners, spans, lang, sure):
    out, at = [], 0
    while at < len(owners):
        end = at
        while end < len(owners) and owners[end] == owners[at]:
            end += 1
        ls, cs = lang[at:end].copy(), sure[at:end]
        known = ls >= 0
        if known.any():
            weight = np.bincount(ls[known], weights=cs[known], minlength=len(LANGUAGES))
            count = np.bincount(ls[known], minlength=len(LANGUAGES))
            main = int(weight.argmax())
            counted = known.copy()
            for i in range(len(ls)):
                if ls[i] < 0 or (ls[i] != main and cs[i] < SURE and count[ls[i]] < 2):
                    ls[i] = main
            a = 0
            number = 0
            while a < len(ls):
                b = a
                while b < len(ls) and ls[b] == ls[a]:
                    b += 1
                mine = counted[a:b]
                start, stop = spans[at + a][0], spans[at + b - 1][1]
                out.append((ids[owners[at]], number, start, stop - start, LANGUAGES[ls[a]], int(mine.sum()), float(cs[a:b][mine].mean()) if mine.any() else 0.0))
                number, a = number + 1, b
        at = end
    return out


def text_languages(found: DataFrame) -> DataFrame:
    """(doc_id, lang, sentences, confidence) of segments(): the languages of each text, being those with at least two
    sentences, or, if none has two, the one with most."""
    per = found.groupBy("doc_id", "lang").agg(F.sum("sentences").alias("sentences"), (F.sum(F.col("confidence") * F.col("sentences")) / F.greatest(F.sum("sentences"), F.lit(1))).alias("confidence"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("sentences"), F.desc("confidence"), "lang")
    return per.withColumn("n", F.row_number().over(w)).where("sentences >= 2 or n = 1").select("doc_id", "lang", "sentences", "confidence")


def relabelled(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """(doc_id, lang, confidence): the languages of each document whose label is missing, names no language or one
    that the text isn't written in, or whose text mixes languages. Empty texts are no cases."""
    model = fit(*training_sample(documents, text, label))
    langs = text_languages(segments(documents, model, doc_id, text))
    told = documents.select(F.col(doc_id).alias("doc_id"), label_language(label).alias("told"))
    all_of = langs.groupBy("doc_id").agg(F.collect_list(F.struct("lang", "confidence")).alias("found"))  # eight at most
    cases = all_of.join(told, "doc_id").where((F.size("found") > 1) | F.coalesce(~F.exists("found", lambda x: x["lang"] == F.col("told")), F.lit(True)))
    return cases.select("doc_id", F.explode("found").alias("x")).select("doc_id", "x.lang", "x.confidence")
