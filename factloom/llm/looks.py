"""Texts that look the same brought to one form of characters."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.json_arrow import slices
from factloom.session import written

# Letters that look like a Latin one, by script, and the Latin letters in the same order.
LOOKS = {
    "cyrillic": ("АВЕЅІЈКМНОРСТУХҮԌԚԜасеһіјорԛѕѵԝхуԁӏԍ", "ABESIJKMHOPCTYXYGQWacehijopqsvwxydlg"),
    "greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹαγιορυνϲϳ", "ABEZHIKMNOPTYXCayiopuvcj"),
    "armenian": ("ՍՏՕԼԶասոհզցյօ", "USOLQwunhqgjo"),
    "cherokee": ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᏀᏃᏎᏚᏙᏞᏟᏢᏦᏴ", "DRTAJEWMHYGZ4SVLCPKB"),
    "lisu": ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),
    "styled": ("ıɡɑ", "iga"),
}
# Where the letters of a script lie.
BLOCKS = {"cyrillic": "\u0400-\u052f", "greek": "\u0370-\u03ff", "armenian": "\u0530-\u058f", "cherokee": "\u13a0-\u13ff", "lisu": "\ua4d0-\ua4ff", "styled": "\u0131\u0251\u0261\u2100-\u214f\u2160-\u2188\U0001d400-\U0001d7ff"}
_LOOK = {a: (script, b) for script, (own, latin) in LOOKS.items() for a, b in zip(own, latin)}
for _c in (*range(0x2100, 0x2150), *range(0x2160, 0x2189), *range(0x1D400, 0x1D800)):  # letters in another style: what their compatibility form is
    if len(_n := unicodedata.normalize("NFKC", chr(_c))) == 1 and _n.isascii() and _n.isalpha():
        _LOOK[chr(_c)] = "styled", _n
_BACK = {script: {b: a for a, b in reversed(list(zip(own, latin)))} for script, (own, latin) in LOOKS.items() if script != "styled"}
# Signs without any look, all single spaces, and hyphens.
_UNSEEN = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
_SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
_HYPHENS = "\u2010\u2011"
_JOINER, _VARIATION = "\u200d", "\ufe0e\ufe0f"
_PICTURES = "\U0001f000-\U0001faff\u2190-\u27bf"

_FOLD: dict[int, str | None] = {ord(c): None for c in _UNSEEN} | {ord(c): " " for c in _SPACES} | {ord(c): "-" for c in _HYPHENS}
for _a, _b in ((0x180B, 0x1810), (0x206A, 0x2070), (0xFE00, 0xFE0E), (0xFFF9, 0xFFFC), (0xE0001, 0xE0080), (0xE0100, 0xE01F0)):  # selectors, tags and marks without a look
    _FOLD.update(dict.fromkeys(range(_a, _b)))
for _a, _b in ((0xFF01, 0xFFEF), (0x2F00, 0x2FD6), (0xF900, 0xFB07), (0x2F800, 0x2FA1E)):  # widths, radicals, compatibility ideographs, ligatures
    for _c in range(_a, _b):
        if (_n := unicodedata.normalize("NFKC", chr(_c))) != chr(_c):
            _FOLD[_c] = _n
_FOLD[0x2126], _FOLD[0x212A], _FOLD[0x212B] = "Ω", "K", "Å"

_JOINED = re.compile(f"(?<![{_PICTURES}{_VARIATION}]){_JOINER}|{_JOINER}(?![{_PICTURES}])|(?<![{_PICTURES}0-9#*])[{_VARIATION}]")
#: Tokens of letters of the scripts that have look-alikes, with their marks.
TOKEN = "[A-Za-z\u00c0-\u024f\u1e00-\u1eff\u0300-\u036f" + "".join(BLOCKS.values()) + "]+"
_TOKEN = re.compile(TOKEN)
_ODD = re.compile("[" + "".join(BLOCKS.values()) + "]")
_SCRIPT = [(script, re.compile(f"[{block}]")) for script, block in BLOCKS.items()]
_LINE_END = re.compile("\r\n?|\u2028|\u2029|\u0085")


def fold(text: str) -> str:
    """One sign for all that look the same whatever stands round it: widths, spaces, hyphens, marks, unseen signs, line ends."""
    if text.isascii():
        return _LINE_END.sub("\n", text) if "\r" in text else text
    text = text.translate(_FOLD)
    if _JOINER in text or any(v in text for v in _VARIATION):
        text = _JOINED.sub("", text)
    return unicodedata.normalize("NFC", _LINE_END.sub("\n", text))


def script(letter: str) -> str:
    """The script of a letter; latin for all without look-alikes in another."""
    if letter.isascii():
        return "latin"
    return next((name for name, own in _SCRIPT if own.match(letter)), "latin")


def evidence(letters: str) -> Counter:
    """Per script, the letters of a text or token that none of its other scripts, nor Latin, has a look-alike of."""
    count = Counter(c for c in unicodedata.normalize("NFD", letters) if c.isalpha() or c in _LOOK)
    kinds = {script(c) for c in count} | {"latin"}
    out: Counter = Counter()
    for c, n in count.items():
        own, latin = _LOOK.get(c, (script(c), c if c.isascii() else None))
        if not any(latin is not None if k == "latin" else latin in _BACK.get(k, ()) for k in kinds - {own}):
            out[own] += n
    return out


def dominant(token: str, said: Counter) -> str | None:
    """The script that a token is written in; None if that is the one all its letters are of.

    In a mixed token it is the script of most letters that the others have no look-alike of, then that of the text by
    the same measure (``said``, its ``evidence``), then Latin, then that of most letters. A token wholly of look-alikes
    is read in the text's script if nothing else in the text speaks for its own: else it is a word of that script.
    """
    letters = [c for c in token if c.isalpha() or c in _LOOK]
    count = Counter(map(script, letters))
    if len(count) < 2:
        own, around = next(iter(count), "latin"), max(said, key=lambda k: (said[k], k == "latin"), default="latin")
        return around if own not in (around, "latin") and not said[own] and all(c in _LOOK for c in letters) else None
    sure = evidence(token)
    return max((k for k in count if k != "styled"), key=lambda k: (sure[k], said[k], k == "latin", count[k]))


def substituted(token: str, said: Counter = Counter()) -> str | None:
    """The token with its look-alikes replaced by letters of its dominant script; None if there is nothing to replace."""
    if not _ODD.search(token):
        return None
    apart = unicodedata.normalize("NFD", token)
    target = dominant(apart, said)
    if target is None:
        return None
    out = []
    for c in apart:
        own, latin = _LOOK.get(c, ("latin", c))
        out.append(c if own == target else latin if target == "latin" else _BACK[target].get(latin, c) if c.isalpha() else c)
    made = unicodedata.normalize("NFC", "".join(out))
    return made if made != token else None


_TABLE = np.arange(0x110000, dtype=np.uint32)
_LONGER: dict[str, str] = {}
_GONE, _END = 0x10FFFE, "\U0010ffff"
for _c, _to in _FOLD.items():
    if _to is None:
        _TABLE[_c] = _GONE
    elif len(_to) == 1:
        _TABLE[_c] = ord(_to)
    else:
        _LONGER[chr(_c)] = _to


def fold_all(texts: list[str | None]) -> list[str | None]:
    """``fold`` of each text, by one table lookup over all characters; texts joined by a noncharacter."""
    joined = _END.join(t or "" for t in texts)
    if joined.count(_END) != max(0, len(texts) - 1) or chr(_GONE) in joined:
        return [None if t is None else fold(t) for t in texts]
    code = _TABLE[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    joined = code[code != _GONE].tobytes().decode("utf-32-le", "surrogatepass")
    for c, to in _LONGER.items():
        if c in joined:
            joined = joined.replace(c, to)
    if _JOINER in joined or any(v in joined for v in _VARIATION):
        joined = _JOINED.sub("", joined)
    joined = _LINE_END.sub("\n", joined)
    if not unicodedata.is_normalized("NFC", joined):
        joined = unicodedata.normalize("NFC", joined)
    return [None if t is None else f for t, f in zip(texts, joined.split(_END))]


def _read(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Folded texts, their tokens with look-alikes (and what they would become), and their other tokens."""
    flat = fold_all(rows.column("_text").to_pylist())
    odd, plain = [], []
    for t in flat:
        tokens, found = set(_TOKEN.findall(t)) if t else set(), {}
        if t and _ODD.search(t):
            said = evidence("".join(_TOKEN.findall(t)))
            found = {w: s for w in tokens if (s := substituted(w, said)) is not None}
        odd.append([{"token": w, "result": s} for w, s in found.items()])
        plain.append([w for w in tokens if w not in found])
    pairs = pa.list_(pa.struct([("token", pa.string()), ("result", pa.string())]))
    return pa.RecordBatch.from_arrays([rows.column("_doc"), pa.array(flat, pa.string()), pa.array(odd, pairs), pa.array(plain, pa.list_(pa.string())), rows.column("_chars")], ["_doc", "_flat", "_odd", "_plain", "_chars"])


def _repair(texts: pa.Array, words: pa.Array) -> pa.Array:
    """Texts with each known token replaced by its result."""
    out = []
    for t, w in zip(texts.to_pylist(), words.to_pylist()):
        known = {x["token"]: x["result"] for x in w or ()}
        out.append(_TOKEN.sub(lambda m: known.get(m[0], m[0]), t) if known and t else t)
    return pa.array(out, pa.string())


def one_form(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(<doc_id>, form, repaired bigint, chars)`` for every row: one consistent form of each text; null stays null.

    Widths, spaces, marks, unseen signs, hyphens and line ends are folded in every text. Look-alike letters are
    substituted by token: in a token of mixed script (or one wholly of look-alikes in a text that is otherwise of
    another script) the letters of other scripts than the dominant one give way if the result is in the corpus'
    vocabulary, that is, if some document writes the result itself or another disguise of it. So texts that look the
    same get the same form even where none of them is clean. Case, traditional and simplified
    characters and the number of spaces are kept. ``chars`` is a digest of the text as it stands. Texts are read
    and folded once, into a table in the shared folder; only tokens cross the shuffle, distinct within each text.
    Ids must be unique and not null.
    """
    base = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text"), F.sha2(text, 256).alias("_chars"))
    schema = T.StructType([base.schema["_doc"], T.StructField("_flat", T.StringType()), T.StructField("_odd", T._parse_datatype_string("array<struct<token:string,result:string>>")), T.StructField("_plain", T.ArrayType(T.StringType())), T.StructField("_chars", T.StringType())])
    read = written(base.mapInArrow(lambda batches: (_read(piece) for batch in batches for piece in slices(batch, "_text", 1 << 20)), schema), "looks")
    doubtful = read.where(F.size("_odd") > 0).select("_doc", F.explode("_odd").alias("_c")).select("_doc", "_c.token", "_c.result")
    spelled = written(doubtful.select("token", "result").distinct(), "spelled")
    results = spelled.groupBy("result").agg(F.count("*").alias("_n"))
    plain = read.select(F.explode("_plain").alias("result")).distinct().join(results.select("result"), "result", "left_semi")  # a frequent word crosses once per task
    vocabulary = results.where("_n > 1").select("result").union(plain).distinct()
    repair = spelled.join(vocabulary, "result", "left_semi").distinct()
    by_doc = doubtful.join(repair, ["token", "result"], "left_semi").groupBy("_doc").agg(F.collect_set(F.struct("token", "result")).alias("_known"))
    mended = read.where(F.size("_odd") > 0).select("_doc", "_flat", "_chars").join(by_doc, "_doc", "left")
    mended = mended.select("_doc", F.arrow_udf(_repair, "string")("_flat", "_known").alias("form"), F.coalesce(F.size("_known"), F.lit(0)).cast("bigint").alias("repaired"), "_chars")
    clean = read.where(F.coalesce(F.size("_odd"), F.lit(0)) <= 0).select("_doc", F.col("_flat").alias("form"), F.lit(0).cast("bigint").alias("repaired"), "_chars")
    return mended.unionByName(clean).withColumnsRenamed({"_doc": doc_id, "_chars": "chars"})


def look_groups(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(<doc_id>, look, chars)`` of texts with a visible character: equal ``look`` means equal form, equal ``chars`` equal text."""
    forms = one_form(docs, doc_id, text).where(visible(F.col("form")))
    return forms.select(doc_id, F.sha2("form", 256).alias("look"), "chars")


def visible(form: Column) -> Column:
    """Whether a folded text has any visible character."""
    return form.rlike(r"(?U)[^\s\p{Cf}\p{Cc}]")


def same_look_pairs(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(doc_a, doc_b)``, ``doc_a`` < ``doc_b``: texts of one look whose characters differ.

    Copies of one text are classes. Classes of one look are paired, each pair once, and the pairs widened to their
    documents, so the work is that of the pairs returned, however many copies a text has. Looks of a single class
    drop out before any pairing.
    """
    members = written(look_groups(docs, doc_id, text).select(F.col(doc_id).alias("_doc"), F.unhex("look").alias("look"), F.unhex("chars").alias("chars")), "members")
    classes = members.groupBy("look", "chars").agg(F.count("*").alias("_n"))
    several = classes.groupBy("look").agg(F.count("*").alias("_k")).where("_k > 1").select("look")
    of = written(members.join(several, "look", "left_semi"), "several")
    one, two = (of.select("look", F.col("chars").alias(c)).distinct() for c in ("_ca", "_cb"))
    pairs = one.join(two, "look").where("_ca < _cb")
    wide = pairs.select("_ca", "_cb").join(of.select(F.col("chars").alias("_ca"), F.col("_doc").alias("_x")), "_ca")  # equal text, equal look
    wide = wide.join(of.select(F.col("chars").alias("_cb"), F.col("_doc").alias("_y")), "_cb")
    return wide.select(F.least("_x", "_y").alias("doc_a"), F.greatest("_x", "_y").alias("doc_b"))
