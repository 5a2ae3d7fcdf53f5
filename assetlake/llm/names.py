"""Variant spellings of names typed by people.

Names become sets of tokens, weighted so that rare tokens count more. The heaviest tokens of a name, which any match
of it must share, are its prefix. Similar tokens are found by a prefix-filtered set-similarity join on their q-grams;
names whose prefixes hold the same or similar tokens are candidates, and a candidate is verified by soft weighted
token similarity: each token of one name is paired with a token of the other that is equal, a typing slip away, an
abbreviation, an initial or a nickname of it, and what stays unpaired on both sides contradicts.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetlake.runtime import cut

Q, EDITS = 3, 2
#: Tokens as heavy as this share of the heaviest token of a name belong to its prefix.
PREFIX_SHARE = 0.5
#: Least soft weighted similarity.
SIMILAR = 0.8

# Usual nicknames of English given names.
NICKNAMES = {
    "alexander": "alex al xander sandy sasha lex", "alexandra": "alex sandra sasha", "benjamin": "ben benny benji", "charles": "charlie chuck chas",
    "charlotte": "charlie lottie lotte char", "christopher": "chris kit topher", "daniel": "dan danny", "dorothy": "dot dolly dottie dora dorrie",
    "edward": "ed eddie ned ted teddy eddy", "elizabeth": "liz beth lizzie betty eliza lisa bess betsy libby elsie", "elisabeth": "liz beth lisa elise",
    "francesca": "fran chesca frankie cesca franny", "francis": "frank frankie fran", "gabriel": "gabe gab", "george": "georgie", "henry": "harry hank hal",
    "isabella": "izzy bella isa ella belle", "james": "jim jimmy jamie", "johannes": "hans jo hannes joe", "john": "jack johnny jon", "joseph": "joe joey jo",
    "katherine": "kate kathy katie kat kit kitty kay", "lawrence": "larry", "margaret": "meg peggy maggie marge madge greta rita daisy", "matthew": "matt",
    "michael": "mike mick mickey micky", "nathaniel": "nate nat nathan", "nicholas": "nick nicky", "olga": "olya olly ola", "patricia": "pat patty tricia trish",
    "patrick": "paddy pat rick packy", "richard": "rick dick rich richie ricky", "robert": "bob rob bobby robbie bert", "samuel": "sam sammy",
    "stephen": "steve", "susannah": "sue susie susan suzie suzy sanna zanna", "theodore": "ted theo teddy", "thomas": "tom tommy", "ursula": "uschi ulla ursel ursie",
    "victoria": "vicky tori vic vicki tory vicki", "william": "bill will billy willy liam", "yvonne": "eve vonnie evie vonny yve",
}
# Usual abbreviations of English dictionaries in names of bands, albums and makers.
WORDS = {"bros": "brothers", "ch": "chamber", "co": "company", "corp": "corporation", "feat": "featuring", "ft": "featuring", "orch": "orchestra", "st": "saint", "vol": "volume", "v": "volume"}
ROMAN = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "x": "10"}
#: Words that many names share count half as much, initials hardly: in a small table they may be rare by chance.
SHARED = frozenset([*NICKNAMES, *(s for v in NICKNAMES.values() for s in v.split()), *WORDS, *WORDS.values()])
SHARED_SHARE, INITIAL_SHARE = 0.5, 0.1
SILENT = frozenset("the and of".split())
_FORMS: dict[str, set[str]] = {}
for _full, _short in NICKNAMES.items():
    for _s in _short.split():
        _FORMS.setdefault(_s, set()).add(_full)


def tokens_of(name: str) -> list[str]:
    """Tokens of a name in order: lower case without accents or punctuation, short forms of words written out, volume
    numbers in digits. & and + are `and`, @ is `at`, a bare 4 between words is `for`."""
    t = unicodedata.normalize("NFKD", name).lower()
    t = "".join(c for c in t if not unicodedata.combining(c)).replace("ß", "ss").replace("ø", "o").replace("ł", "l").replace("æ", "ae")
    t = t.replace("&", " and ").replace("+", " and ").replace("@", " at ").replace("'", "").replace("’", "")
    raw = re.findall(r"\d+tet|v(?=\d)|[^\W\d_]+|\d+", t)
    out: list[str] = []
    for k, w in enumerate(raw):
        after = out[-1] if out else ""
        if after == "volume" and w in ROMAN:
            w = ROMAN[w]
        elif w == "4" and 0 < k < len(raw) - 1 and after != "volume":
            w = "for"
        elif w == "v" and not (k + 1 < len(raw) and raw[k + 1].isdigit()):
            pass  # an initial
        else:
            w = WORDS.get(w, w)
        out.append(w.lstrip("0") or "0" if w.isdigit() else w)
    return out


@lru_cache(maxsize=200_000)
def edits(a: str, b: str, most: int = EDITS) -> int:
    """Edit distance in which swapping neighbours is one edit; most + 1 if it is greater."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


@lru_cache(maxsize=200_000)
def token_similarity(a: str, b: str) -> float:
    """How far two tokens may stand for each other, 0 to 1. Numbers only equal themselves."""
    if a == b:
        return 1.0
    if a.isdigit() or b.isdigit():
        return 0.0
    fa, fb = {a, *_FORMS.get(a, ())}, {b, *_FORMS.get(b, ())}
    if fa & fb:
        return 0.95
    if len(a) == 1 or len(b) == 1:
        x, y = (a, fb) if len(a) == 1 else (b, fa)
        return 0.8 if any(f[0] == x for f in y if len(f) > 1) else 0.0
    for x in fa:
        for y in fb:
            n = min(len(x), len(y))
            if n >= 4 and edits(x, y) <= (2 if n >= 8 else 1):
                return 0.9
    a, b = respelled(a), respelled(b)
    if a == b:
        return 0.9
    short, long = sorted((a, b), key=len)
    if len(short) >= 2 and len(long) > len(short) + (len(short) < 3) and (long.startswith(short) or (short[0] == long[0] and not set(short[1:]) & set("aeiou") and _within(short, long))):
        return 0.85
    return 0.0


def respelled(t: str) -> str:
    """A token by its sound: spellings that informal English puts for each other (night, nite; pic, pick; phat, fat)."""
    return t.replace("ight", "ite").replace("ck", "k").replace("c", "k").replace("ph", "f").replace("4", "quar" if t.endswith("tet") else "for")


def _within(short: str, long: str) -> bool:
    rest = iter(long)
    return all(c in rest for c in short)


def _split(t: list[str], w: list[float], c: list[str], u: list[str], wu: list[float], cu: list[str]):
    """t, w, c with tokens that are two neighbours of u written as one taken apart."""
    ends = {u[m] + u[m + 1]: m for m in range(len(u) - 1)}
    if not any(x in ends for x in t):
        return t, w, c
    out = [([u[m], u[m + 1]], wu[m : m + 2], cu[m : m + 2]) if (m := ends.get(x, -1)) >= 0 else ([x], [w[k]], [c[k]]) for k, x in enumerate(t)]
    return tuple([y for part in out for y in part[i]] for i in range(3))


def _spoken(t: list[str]) -> list[str]:
    return sorted(x for x in t if x not in SILENT) or sorted(t)


def same_name(ta: list[str], tb: list[str], wa: list[float], wb: list[float], ca: list[str], cb: list[str]) -> float:
    """Soft weighted similarity of two names, 0 if they contradict. t: tokens, w: their weights, c: the common
    spelling of each."""
    ta, wa, ca, tb, wb, cb = *_split(ta, wa, ca, tb, wb, cb), *_split(tb, wb, cb, ta, wa, ca)
    if _spoken(ta) == _spoken(tb):
        return 1.0
    pairs = []
    for i, x in enumerate(ta):
        for j, y in enumerate(tb):
            s = 0.92 if x != y and ca[i] == cb[j] else token_similarity(x, y)
            if s:
                pairs.append((s, min(wa[i], wb[j]), i, j))
    used_a, used_b, got, full, rare = set(), set(), 0.0, 0, False
    heavy_a, heavy_b = PREFIX_SHARE * max(wa, default=0.0), PREFIX_SHARE * max(wb, default=0.0)
    for s, w, i, j in sorted(pairs, key=lambda p: (-p[0], -p[1], p[2], p[3])):
        if i not in used_a and j not in used_b:
            used_a.add(i)
            used_b.add(j)
            got += s * w
            full += ta[i] not in SILENT
            rare |= s > 0.8 and wa[i] >= heavy_a and wb[j] >= heavy_b and ta[i] not in SHARED and tb[j] not in SHARED
    rest_a, rest_b = ([k for k in range(len(t)) if k not in used] for t, used in ((ta, used_a), (tb, used_b)))
    if not rare:  # a rare token of each must stand for one of the other, not for an initial
        return 0.0
    loose = lambda t, rest: [k for k in rest if t[k] not in SILENT and not (t[k].isalpha() and len(t[k]) == 1 and full > 1)]
    left_a, left_b = loose(ta, rest_a), loose(tb, rest_b)
    if left_a and left_b or any(ta[k].isdigit() for k in left_a) or any(tb[k].isdigit() for k in left_b):
        return 0.0
    drop = lambda t, w, rest: sum(w[k] for k in range(len(t)) if not (k in rest and (t[k] in SILENT or len(t[k]) == 1)))
    least = min(drop(ta, wa, rest_a), drop(tb, wb, rest_b))
    return min(1.0, got / least) if least > 0 else 0.0


def _tokenised(names: DataFrame) -> DataFrame:
    def run(batches):
        for pdf in batches:
            pdf["tokens"] = [tokens_of(n) for n in pdf["name"]]
            yield pdf

    return names.mapInPandas(run, "field string, name string, rows bigint, tokens array<string>")


def similar_tokens(tokens: DataFrame) -> DataFrame:
    """(field, a, b, d): tokens of a field (field, token) within EDITS edits of each other, a < b; a swap counts two.

    Each edit spoils at most Q of a token's q-grams, so that two such tokens share one of the Q * EDITS + 1 rarest
    of either: only these are joined. Tokens of fewer than five characters are left to short_slips().
    """
    long = tokens.where(F.length("token") >= 5)
    padded = F.concat(F.lit("#" * (Q - 1)), F.col("token"), F.lit("$" * (Q - 1)))
    grams = long.select("field", "token", F.posexplode(F.transform(F.sequence(F.lit(1), F.length(padded) - (Q - 1)), lambda i: F.substring(padded, i, F.lit(Q)))).alias("at", "gram"))
    counts = grams.groupBy("field", "gram").count()
    w = Window.partitionBy("field", "token").orderBy("count", "gram", "at")  # a token's own grams: few rows
    prefix = grams.join(counts, ["field", "gram"]).withColumn("n", F.row_number().over(w)).where(F.col("n") <= Q * EDITS + 1).select("field", "gram", "at", "token")
    prefix = cut(prefix, "grams")
    other = prefix.select("field", "gram", F.col("at").alias("at_b"), F.col("token").alias("b"))
    near = (F.col("token") < F.col("b")) & (F.abs(F.col("at") - F.col("at_b")) <= EDITS) & (F.abs(F.length("token") - F.length("b")) <= EDITS)
    pairs = prefix.join(other, ["field", "gram"]).where(near).withColumn("d", F.levenshtein("token", "b", EDITS)).where("d >= 0")
    return pairs.select("field", F.col("token").alias("a"), "b", "d").distinct()


def short_slips(tokens: DataFrame) -> DataFrame:
    """(field, a, b): tokens of a field, a < b, of four characters, or four and five, that become equal when at most one
    character of each is left out: all that are one typing slip apart, and a few more."""
    words = tokens.where(F.length("token").between(4, 5) & ~F.col("token").rlike(r"^\d+$")).select("field", "token")
    without = F.transform(F.sequence(F.lit(1), F.length("token")), lambda i: F.concat(F.substring(F.col("token"), F.lit(1), i - 1), F.substring(F.col("token"), i + 1, F.length("token"))))
    keys = words.select("field", "token", F.explode(F.array_distinct(F.concat(F.array("token"), without))).alias("key"))
    other = keys.select("field", F.col("token").alias("b"), "key")
    near = (F.col("token") < F.col("b")) & (F.least(F.length("token"), F.length("b")) == 4)
    return keys.join(other, ["field", "key"]).where(near).select("field", F.col("token").alias("a"), "b").distinct()


def joined_pairs(spelled: DataFrame, heavy: DataFrame, known: DataFrame, top: DataFrame) -> DataFrame:
    """(field, na, nb) of names with a token that the other has as two neighbours, if it or one of them weighs enough to
    belong to the prefix of the name that has it."""
    two = F.transform(F.sequence(F.lit(0), F.size("tokens") - 2), lambda i: F.struct(F.get("tokens", i).alias("x"), F.get("tokens", i + 1).alias("y")))
    split = spelled.where("size(tokens) >= 2").select("field", F.col("name").alias("nb"), F.explode(F.array_distinct(two)).alias("p")).select("field", "nb", "p.x", "p.y", F.concat("p.x", "p.y").alias("token"))
    split = split.join(heavy.select("field", "token"), ["field", "token"], "left_semi")
    weight = lambda t: heavy.select("field", F.col("token").alias(t), F.col("common_weight").alias(f"w{t}"))
    split = split.join(weight("x"), ["field", "x"]).join(weight("y"), ["field", "y"])
    whole = known.join(top, ["field", "name"]).select("field", F.col("name").alias("na"), "token", "weight", "top")
    return split.join(whole, ["field", "token"]).where(F.greatest("weight", "wx", "wy") >= F.col("top") * PREFIX_SHARE).select("field", "na", "nb")


def common_spellings(tokens: DataFrame, similar: DataFrame) -> DataFrame:
    """(field, token, common): the most frequent token that is one typing slip away, if it is more frequent."""
    swap = (F.col("d") == 2) & (F.length("a") == F.length("b")) & (F.array_sort(F.split("a", "")) == F.array_sort(F.split("b", "")))
    slips = similar.where((F.col("d") == 1) | swap)
    both = slips.select("field", F.col("a").alias("token"), F.col("b").alias("other")).unionByName(slips.select("field", F.col("b").alias("token"), F.col("a").alias("other")))
    freq = tokens.select("field", F.col("token").alias("other"), F.col("rows").alias("other_rows"))
    best = both.join(freq, ["field", "other"]).groupBy("field", "token").agg(F.max(F.struct("other_rows", "other")).alias("o"))
    out = tokens.join(best, ["field", "token"], "left")
    return out.select("field", "token", F.when(F.col("o.other_rows") > F.col("rows"), F.col("o.other")).otherwise(F.col("token")).alias("common"))


def variant_pairs(names: DataFrame) -> DataFrame:
    """(field, name_a, name_b, similarity): two spellings of the same entity, name_a < name_b by code point.

    names: field, name and any others; null and empty names are none, repeated rows count towards a spelling's
    frequency only. Names without letters or digits match nothing.
    """
    distinct = names.where("name is not null and name <> ''").groupBy("field", "name").agg(F.count(F.lit(1)).alias("rows"))
    spelled = cut(_tokenised(distinct).where(F.size("tokens") > 0), "spellings")
    exploded = spelled.select("field", "name", "rows", F.explode(F.array_distinct("tokens")).alias("token"))
    tokens = exploded.groupBy("field", "token").agg(F.count(F.lit(1)).alias("df"), F.sum("rows").alias("rows"))
    total = spelled.groupBy("field").agg(F.count(F.lit(1)).alias("names"))
    tokens = tokens.join(F.broadcast(total), "field")  # one row a field
    share = F.when(F.length("token") == 1, INITIAL_SHARE).when(F.col("token").isin(sorted(SHARED)), SHARED_SHARE).otherwise(1.0)
    tokens = cut(tokens.select("field", "token", "rows", (F.log1p(F.col("names") / F.col("df")) * share).alias("weight")), "tokens")
    similar = cut(similar_tokens(tokens), "similar")
    common = cut(common_spellings(tokens, similar).join(tokens.select("field", "token", "weight"), ["field", "token"]), "common")
    # The weight of a misspelt token is that of its common spelling, or slips would count more than names.
    heavy = cut(common.join(tokens.select("field", F.col("token").alias("common"), F.col("weight").alias("common_weight")), ["field", "common"]), "heavy")
    known = exploded.join(heavy, ["field", "token"]).select("field", "name", "token", "common", F.col("common_weight").alias("weight"))
    known = cut(known, "known")
    # Silent tokens aren't asked for, so that they don't keep others out of the prefix.
    top = known.groupBy("field", "name").agg(F.coalesce(F.max(F.when(~F.col("token").isin(sorted(SILENT)), F.col("weight"))), F.max("weight")).alias("top"))
    prefix = cut(known.join(top, ["field", "name"]).where(F.col("weight") >= F.col("top") * PREFIX_SHARE).select("field", "name", "token", "common"), "prefix")
    by_common = prefix.select("field", "name", "common").distinct()
    other = by_common.select("field", F.col("name").alias("name_b"), "common")
    pairs = by_common.join(other, ["field", "common"]).select("field", F.col("name").alias("name_a"), "name_b").where("name_a < name_b")
    # Similar tokens without a common spelling between them.
    canon = common.select("field", "token", "common")
    loose = similar.join(canon.select("field", F.col("token").alias("a"), F.col("common").alias("x")), ["field", "a"]).join(canon.select("field", F.col("token").alias("b"), F.col("common").alias("y")), ["field", "b"]).where("x <> y").select("field", "a", "b")
    loose = loose.unionByName(short_slips(tokens))
    linked = loose.join(prefix.select("field", F.col("name").alias("na"), F.col("token").alias("a")), ["field", "a"]).join(prefix.select("field", F.col("name").alias("nb"), F.col("token").alias("b")), ["field", "b"])
    linked = linked.select("field", "na", "nb").unionByName(joined_pairs(spelled, heavy, known, top))
    pairs = pairs.unionByName(linked.where("na <> nb").select("field", F.least("na", "nb").alias("name_a"), F.greatest("na", "nb").alias("name_b"))).distinct()
    # The tokens in order, with their weights and common spellings.
    info = known.groupBy("field", "name").agg(F.map_from_entries(F.collect_list(F.struct("token", F.struct("weight", "common")))).alias("m"))
    info = spelled.join(info, ["field", "name"]).select(
        "field", "name", "tokens", F.transform("tokens", lambda t: F.try_element_at("m", t)["weight"]).alias("w"), F.transform("tokens", lambda t: F.try_element_at("m", t)["common"]).alias("c")
    )
    info = cut(info, "info")
    side = lambda s: info.select("field", F.col("name").alias(f"name_{s}"), F.col("tokens").alias(f"t{s}"), F.col("w").alias(f"w{s}"), F.col("c").alias(f"c{s}"))
    full = pairs.join(side("a"), ["field", "name_a"]).join(side("b"), ["field", "name_b"]).select("field", "name_a", "name_b", "ta", "wa", "ca", "tb", "wb", "cb")

    def verify(batches):
        for pdf in batches:
            s = [same_name(*map(list, x)) for x in zip(pdf.ta, pdf.tb, pdf.wa, pdf.wb, pdf.ca, pdf.cb)]
            out = pd.DataFrame({"field": pdf.field, "name_a": pdf.name_a, "name_b": pdf.name_b, "similarity": s})
            yield out[out.similarity >= SIMILAR]

    return full.mapInPandas(verify, "field string, name_a string, name_b string, similarity double")


def typed_names(audio: DataFrame, video: DataFrame) -> DataFrame:
    """(field, name) of audio.artist, audio.album and video.make."""
    pick = lambda df, c, f: df.select(F.lit(f).alias("field"), F.col(c).alias("name"))
    return pick(audio, "artist", "artist").unionByName(pick(audio, "album", "album")).unionByName(pick(video, "make", "make"))
