"""Text and JSON expressions of the fact-checking pipelines, all built from Spark's own functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Property names that are not shown, and what joins the others.
HIDDEN_PROPS = ("id", "doc_id", "name")
PROP_JOIN = "；"
# The sentence that shows one fact, with and without its time, and what stands for a part without properties.
SENTENCE = "{n}. {head} 透過關係【{relation}】與 {tail} 建立連結，說明：{reason}。"
DATED_SENTENCE = "{n}. {head} 透過關係【{relation}】與 {tail} 建立連結，說明：{reason}；事件時間：{time}。"
HEAD_ROLE, TAIL_ROLE = "主體", "受體"
STOP = "。"
# What stands before the date of a news text and of a question.
NEWS_DATE, QUESTION_DATE = "新聞日期：", "事件詢問日期："

# Line breaks, a code fence, what opens a numbered line.
_LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\x{2028}\x{2029}]"
_FENCE = r"(?i)^\s*```(?:json)?\s*|\s*```\s*$"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_text(text: Column | str) -> Column:
    """Without a leading byte-order mark and outer white space of any kind."""
    return F.regexp_replace(F.regexp_replace(_col(text), r"^\x{FEFF}", ""), r"(?U)^\s+|\s+$", "")


def clean_json_fence(text: Column | str) -> Column:
    """Without a code fence round it (an opening one may name json in any case), trimmed."""
    return strip_text(F.regexp_replace(_col(text), _FENCE, ""))


def drop_trailing_commas(text: Column | str) -> Column:
    """Without commas before a closing bracket."""
    return F.regexp_replace(_col(text), r",\s*([}\]])", "$1")


def is_json(text: Column | str) -> Column:
    """Whether the whole text is one JSON value: in brackets it makes a list of one. Equal member names are allowed."""
    return F.coalesce(F.json_array_length(F.concat(F.lit("["), _col(text), F.lit("]"))) == 1, F.lit(False))


def safe_json(text: Column | str) -> Column:
    """Text of the JSON value, if need be after commas before closing brackets are taken out; null if it can't be read."""
    cleaned = clean_json_fence(text)
    mended = drop_trailing_commas(cleaned)
    return F.when(is_json(cleaned), cleaned).when(is_json(mended), mended)


def first_json_object(text: Column | str) -> Column:
    """From the first ``{`` to the ``}`` that balances it (braces inside strings count too); null if none does.

    The depth before each brace is a sum over the braces alone, not over all characters.
    """
    t = _col(text)
    tail = F.substr(t, F.locate("{", t))
    stretches = F.regexp_extract_all(tail, F.lit("[^{}]*[{}]"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda s, p: F.struct(
        (s["depth"] + F.when(p.endswith("{"), 1).otherwise(-1)).alias("depth"),
        (s["n"] + F.length(p)).alias("n"),
        F.when((s["end"] == 0) & p.endswith("}") & (s["depth"] == 1), s["n"] + F.length(p)).otherwise(s["end"]).alias("end"),
    )
    end = F.aggregate(stretches, start, step)["end"]
    return F.when(F.contains(t, F.lit("{")) & (end > 0), F.substr(tail, F.lit(1), end))


def extract_json_block(text: Column | str) -> Column:
    """The object in a json code fence, else the first balanced object; null if it isn't JSON."""
    fenced = F.regexp_extract(_col(text), r"(?is)```json\s*(\{.*?\})\s*```", 1)
    found = F.coalesce(F.when(fenced != "", fenced), first_json_object(text))
    return F.when(is_json(found), found)


def payload_object(text: Column | str) -> Column:
    """From the first ``{`` to the last ``}``, commas before closing brackets taken out; null if it isn't a JSON object."""
    body = drop_trailing_commas(F.regexp_extract(_col(text), r"(?s)\{.*\}", 0))
    return F.when((body != "") & is_json(body), body)


def ensure_list(text: Column | str) -> Column:
    """A member that is one text or a list of texts, as list; null and missing give the empty list."""
    t = _col(text)
    many = F.from_json(t, "array<string>")
    return F.filter(F.when(t.isNull(), F.array().cast("array<string>")).when(t.startswith("["), F.coalesce(many, F.array(t))).otherwise(F.array(t)), lambda x: x.isNotNull())


def json_props(text: Column | str) -> Column:
    """Property text as map, the last of equal names winning; null, blank and broken text give the empty map."""
    read = F.when(is_json(text), F.from_json(_col(text), "map<string,string>"))
    names = F.array_distinct(F.map_keys(read))
    last = F.transform(names, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(F.map_entries(read), lambda e: e["key"] == k), -1)["value"].alias("value")))
    return F.coalesce(F.map_from_entries(last), F.create_map().cast("map<string,string>"))


def format_props(props: Column | str) -> Column:
    """``name:value`` of the shown, non-null properties, in their order."""
    shown = F.map_filter(_col(props), lambda k, v: ~k.isin(*HIDDEN_PROPS) & v.isNotNull())
    return F.array_join(F.transform(F.map_entries(shown), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), PROP_JOIN)


def format_entity(name: Column | str, props: Column | str, role: str) -> Column:
    """``name（properties）``, or ``name（role）`` without any to show."""
    shown = format_props(props)
    return F.concat(_col(name), F.lit("（"), F.when(shown == "", role).otherwise(shown), F.lit("）"))


def verbalise(head, relation, tail, head_props, rel_props, tail_props, number: int = 1) -> Column:
    """The sentence that shows one fact. The reason is the evidence if that property is there at all, else the relation."""
    props = _col(rel_props)
    reason = F.when(F.map_contains_key(props, F.lit("evidence")), F.coalesce(props["evidence"], F.lit(""))).otherwise(_col(relation))
    said = lambda k: F.when(F.coalesce(props[k], F.lit("")) != "", props[k])
    moment = F.coalesce(said("date"), said("time"))
    parts = {"n": F.lit(str(number)), "head": format_entity(head, head_props, HEAD_ROLE), "relation": _col(relation), "tail": format_entity(tail, tail_props, TAIL_ROLE), "reason": reason, "time": moment}
    filled = lambda form: F.concat(*(parts[p[1:-1]] if p[:1] == "{" else F.lit(p) for p in re.split(r"(\{\w+\})", form) if p))
    return F.when(moment.isNotNull(), filled(DATED_SENTENCE)).otherwise(filled(SENTENCE))


def split_lines(text: Column | str) -> Column:
    """Lines at any line break; a break at the end opens no further line, empty text has none."""
    parts = F.split(_col(text), _LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def entity_key_full(line: Column | str) -> Column:
    """First entity of a line with its properties; the text before the first space if the line has no such form."""
    found = F.regexp_extract(_col(line), r"(?U)^\d+\.\s*(.+?)\s*透過關係", 1)
    return F.when(found != "", found).otherwise(F.get(F.split(_col(line), " "), 0))


def entity_key_name(line: Column | str) -> Column:
    """Bare name of a line's first entity; its first word if the line has no number; '' for a blank line."""
    found = F.regexp_extract(_col(line), r"(?U)^\d+\.\s*([^\s（]+)", 1)
    return F.when(found != "", found).otherwise(F.regexp_extract(_col(line), r"(?U)\S+", 0))


def renumber_bracket(line: Column | str, i: Column) -> Column:
    """A leading ``N.`` becomes ``[i]``; other lines stay as they are."""
    return F.regexp_replace(_col(line), r"(?U)^\d+\.", F.concat(F.lit("["), i.cast("string"), F.lit("]")))


def renumber_prefix(line: Column | str, i: Column) -> Column:
    """Any leading number is taken off and ``[i] `` put before the line."""
    return F.concat(F.lit("["), i.cast("string"), F.lit("] "), F.regexp_replace(_col(line), r"(?U)^\s*(?:\[\d+\]\.?|\d+\.)\s*", ""))


def triple_text(head, relation, tail, *props) -> Column:
    """``head relation tail`` and, if given, the texts of properties; a null part counts as empty."""
    return F.concat_ws(" ", *(F.coalesce(_col(c), F.lit("")) for c in (head, relation, tail, *props)))


def sub_questions(text: Column | str) -> Column:
    """The questions in a text: what stands between question marks and full stops of both widths, trimmed, blank ones left out."""
    return F.filter(F.transform(F.split(_col(text), "[？?。]"), strip_text), lambda x: x != "")


def request_date(text: Column | str) -> Column:
    """Date of a request, ``year/month/day`` with a four-digit year; null for anything else."""
    t = _col(text)
    return F.when(t.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), F.try_to_date(t, "y/M/d"))


def dated_text(date: Column | str, text: Column | str, prefix: str = NEWS_DATE) -> Column:
    """The text with its date sentence before it."""
    return F.concat(F.lit(prefix), _col(date), F.lit(STOP), _col(text))


def run_id(date: Column | str, utc: Column | str, zone: str = "Asia/Taipei") -> Column:
    """``<date>_<day>_<HHmm>`` by the clock of ``zone``; ``utc`` is a TIMESTAMP_NTZ."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), _col(utc)).cast("string")
    return F.concat(_col(date).cast("string"), F.lit("_"), F.substring(local, 1, 10), F.lit("_"), F.substring(local, 12, 2), F.substring(local, 15, 2))


def id_from_path(path: Column | str, prefix: str = "news_kg_") -> Column:
    """File name without folders, ``prefix`` and the extension .txt (once or twice)."""
    return F.regexp_replace(F.regexp_replace(_col(path), r"^.*/", ""), rf"^{prefix}|(?:\.txt){{1,2}}$", "")


def request_status(text: Column | str, date: Column | str, is_link: Column) -> Column:
    """The first rule a request breaks: NO_TEXT, NO_DATE, NO_URL; OK if none."""
    blank = lambda c: F.coalesce(_col(c), F.lit("")) == ""
    return F.when(blank(text), "NO_TEXT").when(blank(date), "NO_DATE").when(is_link & ~_col(text).rlike(r"^https?://.+\..+"), "NO_URL").otherwise("OK")


def parse_label(label: Column, is_fake: Column, collection: Column) -> Column:
    """Label as number: a given number as it is, else the flag's words, else whether the collection is the fake one."""
    flag = F.lower(strip_text(is_fake)).isin("1", "yes", "true").cast("int")
    return F.coalesce(label, F.when(is_fake.isNotNull(), flag), (collection == "Fake_News").cast("int"), F.lit(0))
