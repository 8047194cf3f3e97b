"""Spellings of one person or organisation linked through a noisy channel.

A spelling reaches us through a channel that may wrap it (quotes, titles, honorifics), reorder it (surname first,
kind before place), shorten it (initials, abbreviations, nicknames, a dropped administrative level) and mistype it.
What marks itself (quotes, brackets, commas, order) is undone by form. What words are titles or other affixes, and which
characters may be left out, is learnt from the corpus: what is taken off many names and leaves another name. The rest is
settled by posteriors: frequent forms are the candidate canonical ones, and each other form goes to the candidate with
the greatest one, prior frequency times the likelihood of the typo or abbreviation that would turn one into the other.
"""

from __future__ import annotations

import math
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.session import written

#: A beginning or an end is an affix if of the names that have it, this share or more is a name without it too, and so many names are.
AFFIX, NAMES = 0.25, 2
#: Longest affix in characters (Chinese) or words (Latin); characters of a name of a person at most.
WIDEST, PERSON = 5, 4
#: A form is taken for a typo of another only if what it adds is so many times rarer in the corpus.
RATIO = 4.0
#: A character is droppable if this share or more of the long Chinese names that have it inside are there without it, as far as chance (z) lets one say.
DROP, CHANCE = 0.05, 1.64
#: Rounds in which the rates of what the channel does to a form are learnt, and where they start; own: the form is a name of its own.
ROUNDS, RATES = 3, {"sub": 0.02, "del": 0.02, "ins": 0.02, "swap": 0.02, "word": 0.02, "initial": 0.2, "own": 1e-4}

_EDGE = re.compile(r"^[\s「」『』\"'“”‘’*·,，。;:、!?#-]+|[\s「」『』\"'“”‘’*·,，。;:、!?#-]+$")
_CJK = re.compile(r"[㐀-䶿一-鿿豈-﫿]")
_EVENT = re.compile(r"第\d+號")
_NICK = re.compile(r'["“(\'‘]([^"”)\'’]+)["”)\'’]')


def tidy(name: str | None) -> tuple[str, list[str], str | None, str | None] | None:
    """``(script, parts, given, nickname)`` of a spelling: characters (zh) or words (en) in the order of the fuller form; None if it names no person or organisation."""
    s = unicodedata.normalize("NFKC", name or "")
    s = "".join(c for c in s if unicodedata.category(c) != "Cf")
    s = _EDGE.sub("", s)
    if not s or _EVENT.search(s):
        return None
    return _chinese(s) if _CJK.search(s) else _latin(s)


def _latin(s: str) -> tuple[str, list[str], str | None, str | None] | None:
    s = s.casefold()
    nick = None
    if m := _NICK.search(s):
        nick = m[1].strip()
        s = s[: m.start()] + " " + s[m.end() :]
    before, comma, after = (x.strip() for x in s.partition(","))
    words = re.split(r"[\s\-_/]+", before)
    if comma and after:
        tail = re.split(r"[\s\-_/]+", after)
        words = tail + words if len(words) == 1 and len(tail) <= 2 else words if tail == words[:1] or len(words) >= 3 else words + tail
    words = [w for w in words if w.strip(".")]
    return ("en", words, words[0] if nick else None, nick) if words else None


def _chinese(s: str) -> tuple[str, list[str], str | None, str | None] | None:
    s = re.sub(r"\s+", "", s).rstrip(".")
    if m := re.fullmatch(r"(.+?)\((.+)\)", s):
        outer, inner = m.groups()
        if re.fullmatch(r".{1,2}姓.*", inner):
            s = inner.partition("姓")[0] + outer
        elif inner == "簡稱" or inner[0] in "阿小老":
            s = outer
        else:
            s = inner + outer
    return ("zh", list(s), None, None) if len(s) > 1 else None


def kind(script: str, parts: list[str]) -> tuple[str, list[str]]:
    """Class and parts of a name without affixes: ``en2`` (two Latin words in alphabetical order), ``en3``, ``enN``, ``zhp`` (up to PERSON characters), ``zho``."""
    if script == "zh":
        return ("zhp" if len(parts) <= PERSON else "zho"), parts
    if len(parts) >= 4 and "of" in parts[1:-1]:
        i = parts.index("of", 1)
        parts = parts[i + 1 :] + parts[:i]
    return ("en2", sorted(parts)) if len(parts) == 2 else ("en3" if len(parts) == 3 else "enN", parts)


def stem_key(script: str, parts: list[str]) -> str:
    """Key of a name for the search of affixes: Latin words whose order may change are sorted."""
    return "".join(parts) if script == "zh" else " ".join(kind("en", [w.rstrip(".") for w in parts])[1])


def cuts(script: str, parts: list[str]) -> list[tuple[str, str, list[str]]]:
    """``(affix, key of the rest, rest)`` for all ways to take a beginning, an end or (Chinese) two inner characters off; the affix tells the size of the rest."""
    out = []
    for k in range(1, min(WIDEST if script == "zh" else 2, len(parts) - 1) + 1):
        if len(parts) - k < 2:
            break
        for x, rest in ((parts[:k], parts[k:]), (parts[-k:], parts[:-k])):
            size = "p" if script == "zh" and len(rest) <= PERSON else "o"
            mark = "".join(x) if script == "zh" else " ".join(w.rstrip(".") for w in x)
            out.append((f"{size}{mark}", stem_key(script, rest), rest))
    if script == "zh" and len(parts) > PERSON + 2:
        for i in range(2, len(parts) - 2):
            rest = parts[:i] + parts[i + 2 :]
            out.append((f"|o{parts[i]}{parts[i + 1]}", stem_key(script, rest), rest))
    return out


def one_edit(a: str | list, b: str | list) -> tuple[str, int] | None:
    """The single edit that turns ``b`` into ``a`` and its place: sub, del (``a`` lacks one), ins or swap; None otherwise."""
    if a == b or abs(len(a) - len(b)) > 1:
        return None
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        if a[i + 1 :] == b[i + 1 :]:
            return "sub", i
        return ("swap", i) if i + 1 < len(a) and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :] else None
    if len(a) < len(b):
        return ("del", i) if a[i:] == b[i + 1 :] else None
    return ("ins", i) if a[i + 1 :] == b[i:] else None


def typo(cls: str, v: list[str], vc: list[int], vb: list[int], vn: int, u: list[str], uc: list[int], ub: list[int], un: int) -> str | None:
    """The kind of typo by which form ``v`` comes from ``u`` (sub, del, ins, swap; word: within a word); None if it doesn't.

    ``vc``, ``uc``: in how many forms of the class each part occurs; ``vb``, ``ub``: the same for pairs of neighbours
    (the ends of a form count as neighbours); ``vn``, ``un``: how often the forms occur. Latin words: one word may
    differ, by one edit; a word seen in no other form gives way to one of several forms, and in a name of three
    words, where two agree, to that of the more frequent form. Characters: one may be another, missing, too many
    or exchanged, only towards a form not RATIO times less frequent; in a name of two to four (``zhp``) one may only be
    another. Forms of different classes never meet. Otherwise what is new in ``v`` must be RATIO times rarer than what it replaces.
    """
    if cls.startswith("en"):
        left, right = list(range(len(v))), list(range(len(u)))
        if cls == "en2":  # unordered
            left, right = [i for i in left if v[i] not in u], [i for i in right if u[i] not in v]
        else:
            left = right = [i for i in left if len(u) == len(v) and v[i] != u[i]]
        if len(left) != 1 or len(right) != 1:
            return None
        i, j = left[0], right[0]
        if len(u[j]) < 4 or "." in v[i] or "." in u[j] or not one_edit(v[i], u[j]):
            return None
        rare = uc[j] >= max(2, RATIO * vc[i]) or vc[i] == 1 < uc[j] or cls != "en2" and vc[i] == uc[j] == 1 and un > vn
        return "word" if rare else None
    e = one_edit(v, u)
    if e is None:
        return None
    kind, i = e
    if RATIO * un < vn:
        return None
    if kind == "sub":
        new, old = vc[i], uc[i]
    elif cls == "zhp":
        return None
    elif kind == "del":
        new, old = vb[i], max(ub[i], ub[i + 1])
    elif kind == "ins":
        new, old = min(vb[i], vb[i + 1]), ub[i]
    else:
        new, old = min(vb[i : i + 3]), min(ub[i : i + 3])
    return kind if old >= max(2, RATIO * new) else None


_TIDY = pa.struct([("script", pa.string()), ("parts", pa.list_(pa.string())), ("given", pa.string()), ("nick", pa.string()), ("key", pa.string())])
_CUT = pa.list_(pa.struct([("affix", pa.string()), ("key", pa.string()), ("rest", pa.list_(pa.string()))]))
_KIND = pa.struct([("cls", pa.string()), ("parts", pa.list_(pa.string()))])


def _tidied(names: pa.Array) -> pa.Array:
    return pa.array([dict(zip(("script", "parts", "given", "nick"), p), key=stem_key(p[0], p[1])) if (p := tidy(n)) else None for n in names.to_pylist()], _TIDY)


def _cut(script: pa.Array, parts: pa.Array) -> pa.Array:
    return pa.array([[dict(zip(("affix", "key", "rest"), c)) for c in cuts(s, p)] for s, p in zip(script.to_pylist(), parts.to_pylist())], _CUT)


def _kinds(script: pa.Array, parts: pa.Array) -> pa.Array:
    return pa.array([dict(zip(("cls", "parts"), kind(s, p))) for s, p in zip(script.to_pylist(), parts.to_pylist())], _KIND)


def without_affixes(got: DataFrame) -> DataFrame:
    """``got(name, script, parts, key, ...)`` with what the corpus shows to be affixes (titles, forms of address, articles) taken off ``parts``.

    For every way to cut a name in two, the rest is looked up among all names: what leaves a name for at least
    AFFIX of those that have it, and for NAMES different rests, is an affix. The longest is taken off, twice over.
    """
    one = got.groupBy("script", "key").agg(F.first("parts").alias("parts"))
    cut = lambda df: df.select("script", F.col("key").alias("_of"), F.explode(F.arrow_udf(_cut, "array<struct<affix:string,key:string,rest:array<string>>>")("script", "parts")).alias("_c")).select("script", "_of", "_c.affix", "_c.key", "_c.rest")
    split = written(cut(one), "cuts")
    there = split.join(one.select("script", "key"), ["script", "key"], "left_semi").groupBy("script", "affix").agg(F.countDistinct("key").alias("_s"))
    every = split.groupBy("script", "affix").agg(F.countDistinct("_of").alias("_t"))
    affixes = written(there.join(every, ["script", "affix"]).where((F.col("_s") >= NAMES) & (F.col("_s") >= AFFIX * F.col("_t"))).select("script", "affix", (F.col("_s") / F.col("_t")).alias("_share")), "affixes")
    for _ in range(2):
        longest = F.struct(F.length("affix"), "_share", "affix")
        off = split.join(affixes, ["script", "affix"]).groupBy("script", "_of").agg(F.max_by("rest", longest).alias("_rest"), F.max_by("key", longest).alias("_key"))
        got = written(got.join(off, (got["script"] == off["script"]) & (got["key"] == off["_of"]), "left").select(*(got[c] for c in got.columns if c not in ("parts", "key")), F.coalesce("_rest", got["parts"]).alias("parts"), F.coalesce("_key", got["key"]).alias("key")), "stems")
        split = cut(off.select("script", F.col("_key").alias("key"), F.col("_rest").alias("parts")).dropDuplicates(["script", "key"]))
    return got


def _deletions(cls: pa.Array, parts: pa.Array) -> pa.Array:
    """Keys under which forms one edit apart meet: the form with one letter of one word, or one character, left out."""
    out = []
    for c, p in zip(cls.to_pylist(), parts.to_pylist()):
        keys = set()
        if c.startswith("en"):
            for i, w in enumerate(p):
                rest = [x for k, x in enumerate(p) if k != i] if c == "en2" else [*p[:i], "", *p[i + 1 :]]
                keys |= {" ".join([*rest, "|", d]) for d in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}}
        else:
            s = "".join(p)
            keys |= {s, *(s[:k] + s[k + 1 :] for k in range(len(s)))}
        out.append(sorted(keys))
    return pa.array(out, pa.list_(pa.string()))


def _typos(*columns: pa.Array) -> pa.Array:
    return pa.array([typo(*row) for row in zip(*(c.to_pylist() for c in columns))], pa.string())


def _abbreviates(short: pa.Array, full: pa.Array) -> pa.Array:
    """3: the same word, 2: its beginning, 1: letters of it in order with the first one, 0: neither."""
    out = []
    for s, f in zip(short.to_pylist(), full.to_pylist()):
        if f == s:
            out.append(3)
        elif f.startswith(s):
            out.append(2)
        else:
            letters = iter(f)
            out.append(int(f[0] == s[0] and len(f) > len(s) + 2 and all(c in letters for c in s)))
    return pa.array(out, pa.int32())


def _ordered(words: pa.Array) -> pa.Array:
    """Keys under which abbreviations find a word, however rare: its beginnings, and its first letter with one or two more in order."""
    out = []
    for w in words.to_pylist():
        keys, seen = {w[:1], w[:2], w[:3]}, set()
        for y in w[:0:-1]:  # from the end: what follows a letter is known
            keys |= {w[0] + y, *(w[0] + y + z for z in seen)}
            seen.add(y)
        out.append(sorted(keys))
    return pa.array(out, pa.list_(pa.string()))


def spellings(*columns: DataFrame) -> DataFrame:
    """``(name, n)``: the distinct non-null texts of the given one-column tables and how often each occurs."""
    every = None
    for c in columns:
        one = c.select(F.col(c.columns[0]).alias("name")).where("name is not null").groupBy("name").agg(F.count("*").alias("n"))
        every = one if every is None else every.union(one)
    return every.groupBy("name").agg(F.sum("n").alias("n"))


def canonical_forms(names: DataFrame) -> DataFrame:
    """``(name, n, cls, form, canonical, log_posterior)`` for each spelling of ``names(name, n)`` that can name a person or organisation.

    ``form`` is the spelling with the traces of the channel undone, ``canonical`` the form it is attached to (its
    own where nothing better is known): equal class and canonical form mean the same entity. Blank texts, numbered
    cases and what else names no person or organisation give no row. Frequencies, affixes, nicknames, abbreviations and
    typos are all taken from the whole table; only the droppable characters are collected, at most a script's.
    """
    read = names.select("name", "n", F.arrow_udf(_tidied, "struct<script:string,parts:array<string>,given:string,nick:string,key:string>")("name").alias("_p")).where("_p is not null")
    read = without_affixes(written(read.select("name", "n", "_p.*"), "names"))
    got = written(read.withColumn("_k", F.arrow_udf(_kinds, "struct<cls:string,parts:array<string>>")("script", "parts")).select("name", "n", "_k.cls", "_k.parts", F.when(F.col("_k.cls") == "en2", F.col("given")).alias("given"), F.when(F.col("_k.cls") == "en2", F.col("nick")).alias("nick")), "classed")

    # characters that the corpus shows to be left out at will, as the level of a place; their number is that of a script's characters at most
    long = got.where("cls = 'zho'").select(F.array_join("parts", "").alias("form")).distinct()
    less = long.select("form", F.explode(F.transform(F.sequence(F.lit(2), F.length("form") - 1), lambda i: F.struct(F.substr("form", i, F.lit(1)).alias("part"), F.concat(F.substr("form", F.lit(1), i - 1), F.substr("form", i + 1)).alias("key")))).alias("_c")).select("form", "_c.*")
    left = less.join(got.where("cls like 'zh%'").select(F.array_join("parts", "").alias("key")).distinct(), "key", "left_semi").groupBy("part").agg(F.countDistinct("form").alias("_d"))
    share, n = F.col("_d") / F.col("_n"), F.col("_n")
    loose = left.join(less.groupBy("part").agg(F.countDistinct("form").alias("_n")), "part").where((F.col("_d") > NAMES) & (share - CHANCE * F.sqrt(share * (1 - share) / n) >= DROP))
    loose = [r["part"] for r in loose.select("part").collect()]
    tight = F.filter("parts", lambda x, i: (i == 0) | (i == F.size("parts") - 1) | ~x.isin(loose))
    got = got.withColumn("parts", F.when((F.col("cls") == "zho") & (F.size(tight) > 2), tight).otherwise(F.col("parts")))

    # words that stand for others: nicknames as the corpus itself explains them, abbreviations by frequency and letters
    latin = got.where("cls like 'en%'")
    word = latin.select("name", "cls", F.posexplode("parts").alias("pos", "word"))
    often = word.groupBy("cls", "word").agg(F.count("*").alias("tf"))
    best = lambda *by: F.row_number().over(Window.partitionBy("cls", "word").orderBy(*by))
    nick = latin.where("nick is not null and given is not null").groupBy("cls", F.col("nick").alias("word"), F.col("given").alias("to")).agg(F.count("*").alias("_n"))
    nick = nick.withColumn("_r", best(F.col("_n").desc(), "to")).where("_r = 1 and word <> to").select("cls", "word", "to")
    # an abbreviation is looked up by its first letters: at the word's beginning, or anywhere in order after its first one
    letters = lambda c: F.substring(c, 1, 3)
    short = often.where("word like '%.' and length(word) > 2").select("cls", "word", F.regexp_replace("word", r"\.+$", "").alias("_s")).where("_s <> ''").withColumn("_i", letters("_s"))
    full = often.where("word not like '%.%' and length(word) > 1").select("cls", F.col("word").alias("to"), "tf", F.explode(F.arrow_udf(_ordered, "array<string>")("word")).alias("_i"))
    fits = short.join(full, ["cls", "_i"]).withColumn("_k", F.arrow_udf(_abbreviates, "int")("_s", "to")).where("_k > 0")
    fits = fits.withColumn("_score", F.log("tf") + F.col("_k") * 1.5)
    abbr = fits.withColumn("_r", best(F.col("_score").desc(), "to")).where("_r = 1").select("cls", "word", "to")
    stands = abbr.unionByName(nick).groupBy("cls", "word").agg(F.min("to").alias("to"))
    mended = word.join(stands, ["cls", "word"], "left").groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("to", F.when(F.col("word").rlike(r"^..+\.$"), F.regexp_replace("word", r"\.+$", "")), "word").alias("w")))), lambda x: x["w"]).alias("_w"))
    formed = got.join(mended, "name", "left").withColumn("parts", F.coalesce(F.when(F.col("cls") == "en2", F.array_sort("_w")).otherwise(F.col("_w")), F.col("parts")))
    formed = formed.withColumn("form", F.when(F.col("cls").startswith("en"), F.array_join("parts", " ")).otherwise(F.array_join("parts", "")))
    formed = written(formed.select("name", "n", "cls", "form", "parts"), "forms")

    # forms with the frequencies of their parts and pairs
    form = formed.groupBy("cls", "form").agg(F.sum("n").alias("n"), F.first("parts").alias("parts"))
    part = form.select("cls", "form", F.posexplode("parts").alias("pos", "part"))
    tf = part.groupBy("cls", "part").agg(F.count("*").alias("tf"))
    counted = part.join(tf, ["cls", "part"]).groupBy("cls", "form").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tf"))), lambda x: x["tf"]).alias("pc"))
    ends = F.concat(F.array(F.lit("^")), "parts", F.array(F.lit("$")))
    pairs = F.transform(F.sequence(F.lit(0), F.size("parts")), lambda i: F.concat(F.get(ends, i), F.get(ends, i + 1)))
    pair = form.where("cls like 'zh%'").select("cls", "form", F.posexplode(pairs).alias("pos", "part"))
    bf = pair.groupBy("cls", "part").agg(F.count("*").alias("tf"))
    paired = pair.join(bf, ["cls", "part"]).groupBy("cls", "form").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tf"))), lambda x: x["tf"]).alias("pb"))
    form = form.join(counted, ["cls", "form"]).join(paired, ["cls", "form"], "left").withColumn("pb", F.coalesce("pb", F.array().cast("array<bigint>")))
    form = written(form, "counted")

    # candidates: forms one edit apart, and full names for initials
    met = form.select("cls", "form", F.explode(F.arrow_udf(_deletions, "array<string>")("cls", "parts")).alias("_key"))
    near = met.alias("a").join(met.alias("b"), (F.col("a.cls") == F.col("b.cls")) & (F.col("a._key") == F.col("b._key")) & (F.col("a.form") != F.col("b.form"))).select("a.cls", F.col("a.form").alias("form"), F.col("b.form").alias("to")).distinct()
    v = form.select("cls", "form", F.col("parts").alias("_v"), F.col("pc").alias("_vc"), F.col("pb").alias("_vb"), F.col("n").alias("_vn"))
    u = form.select("cls", F.col("form").alias("to"), F.col("parts").alias("_u"), F.col("pc").alias("_uc"), F.col("pb").alias("_ub"), F.col("n").alias("_un"))
    likely = near.join(v, ["cls", "form"]).join(u, ["cls", "to"]).withColumn("kind", F.arrow_udf(_typos, "string")("cls", "_v", "_vc", "_vb", "_vn", "_u", "_uc", "_ub", "_un")).where("kind is not null")
    likely = likely.select("cls", "form", "to", "kind", F.log("_un").alias("prior"))
    two = form.where("cls = 'en2'").select("form", "n", F.get("parts", 0).alias("p"), F.get("parts", 1).alias("q"))
    sided = two.select("form", "n", F.explode(F.array(F.struct(F.col("p").alias("other"), F.col("q").alias("own")), F.struct(F.col("q").alias("other"), F.col("p").alias("own")))).alias("_s")).select("form", "n", "_s.other", "_s.own")
    initial = sided.where(F.col("own").rlike(r"^\pL\.?$")).select(F.col("form"), "other", F.substring("own", 1, 1).alias("_i"))
    whole = sided.where(~F.col("own").rlike(r"^\pL\.?$") & ~F.col("other").rlike(r"^\pL\.?$")).select(F.col("form").alias("to"), "n", "other", F.substring("own", 1, 1).alias("_i"), F.col("own"))
    whole = whole.join(tf.where("cls = 'en2'").select(F.col("part").alias("own"), "tf"), "own")
    spelled = initial.join(whole, ["other", "_i"]).select(F.lit("en2").alias("cls"), "form", "to", F.lit("initial").alias("kind"), (F.log("n") + F.log("tf")).alias("prior"))
    link = attached(likely.unionByName(spelled), form)

    step = followed(link)
    out = formed.select("name", "n", "cls", "form").join(step, ["cls", "form"], "left")
    return out.select("name", "n", "cls", "form", F.coalesce("to", "form").alias("canonical"), "log_posterior")


def attached(candidates: DataFrame, form: DataFrame) -> DataFrame:
    """``(cls, form, to, log_posterior)``: the candidate of each form with the greatest posterior, unless that of being a name of its own is greater.

    ``candidates(cls, form, to, kind, prior)``; ``form(cls, form, n)``. A candidate's posterior is its prior times the rate of the
    kind; the rates are learnt by expectation-maximisation over all candidates of a class, as shares of its occurrences; what they
    start from counts as much as a hundredth of those. The rate of own names, that of a name which by chance looks like a slip of another, stays as it is.
    """
    counted = form.select("cls", "form", "n")
    own = counted.join(candidates.select("cls", "form").distinct(), ["cls", "form"]).select("cls", "form", F.lit(None).cast("string").alias("to"), F.lit("own").alias("kind"), F.log("n").alias("prior"))
    every = written(candidates.unionByName(own).join(counted, ["cls", "form"]), "candidates")
    mass = {r["cls"]: r["n"] for r in counted.groupBy("cls").agg(F.sum("n").alias("n")).collect()}  # as many as classes
    rates = {(c, k): v for c in mass for k, v in RATES.items()}
    at = lambda: F.element_at(F.create_map(*(F.lit(x) for (c, k), v in rates.items() for x in (f"{c} {k}", math.log(v)))), F.concat_ws(" ", "cls", "kind"))
    if mass:
        for _ in range(ROUNDS):
            scored = every.withColumn("_p", F.exp(F.col("prior") + at()))
            share = scored.withColumn("_r", F.col("_p") / F.sum("_p").over(Window.partitionBy("cls", "form")) * F.col("n"))
            learnt = {(r["cls"], r["kind"]): r["s"] for r in share.groupBy("cls", "kind").agg(F.sum("_r").alias("s")).collect()}  # as many as kinds
            rates = {(c, k): RATES[k] if k == "own" else (learnt.get((c, k), 0.0) + mass[c] * RATES[k] / 100) / (mass[c] * 1.01) for c, k in rates}
        every = every.withColumn("log_posterior", F.col("prior") + at())
    else:
        every = every.withColumn("log_posterior", F.col("prior"))
    top = Window.partitionBy("cls", "form").orderBy(F.col("log_posterior").desc(), "to")
    best = every.withColumn("_r", F.row_number().over(top)).where("_r = 1 and to is not null")
    return written(best.select("cls", "form", "to", "log_posterior"), "links")


def followed(link: DataFrame) -> DataFrame:
    """``link(cls, form, to, log_posterior)`` with ``to`` replaced by the end of its chain, by doubling until nothing moves.

    Each form has one link at most. Where links go round in a ring, the greatest form of the ring is its end.
    """
    step, rounds = link, max(1, link.count()).bit_length() + 1
    while True:
        for _ in range(rounds):
            ahead = step.select("cls", F.col("form").alias("to"), F.col("to").alias("_next"))
            moved = step.join(ahead, ["cls", "to"], "left")
            if not moved.where("_next is not null").limit(1).count():
                return step
            step = written(moved.select("cls", "form", F.coalesce("_next", "to").alias("to"), "log_posterior"), "links")
        # what still moves has come to a ring, and all forms of rings are reached by some
        ring = written(step.join(link.select("cls", F.col("form").alias("to")), ["cls", "to"], "left_semi").select("cls", F.col("to").alias("form")).distinct(), "ring")
        walk = link.join(ring, ["cls", "form"], "left_semi").select("cls", "form", "to", F.col("form").alias("most"))
        for _ in range(rounds):
            ahead = walk.select("cls", F.col("form").alias("to"), F.col("to").alias("_next"), F.col("most").alias("_m"))
            walk = written(walk.join(ahead, ["cls", "to"]).select("cls", "form", F.col("_next").alias("to"), F.greatest("most", "_m").alias("most")), "ring")
        link = written(link.join(walk.where("most = form").select("cls", "form"), ["cls", "form"], "left_anti"), "links")
        step = link


def same_entity_pairs(forms: DataFrame) -> DataFrame:
    """``(name_a, name_b)``, ``name_a`` < ``name_b``: different spellings attached to one canonical form."""
    one = forms.select("cls", "canonical", F.col("name").alias("name_a"))
    two = forms.select("cls", "canonical", F.col("name").alias("name_b"))
    return one.join(two, ["cls", "canonical"]).where("name_a < name_b").select("name_a", "name_b")
