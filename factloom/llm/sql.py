"""Oracle SQL of this subpackage's queries, where SQL can express them over whole tables."""

# A full stop that ends no sentence counts as one character; it is replaced by a letter before the stretch is measured.
_INNER = r"\.([^\t-\r\x1C-\x1F\x{85}\p{Z}])"
_RUN = r"[^。！？!?.\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]{601}"


def _hard(text: str) -> str:
    once = lambda x: rf"regexp_replace({x}, '{_INNER}', 'x\1', 'g')"
    return rf"case when regexp_matches(regexp_replace({once(once(text))}, '\.$', 'x'), '{_RUN}') then 1 else 0 end::bigint"


SQL: dict[str, str] = {
    "p8_decoded": "select doc_id, coalesce(\"text\", '') \"text\" from documents",
    "p7_found": f"""with t as (select distinct 'news_in' tbl, doc_id item_id, 'text' field, "text" v from news_in where length("text") > 600
      union all select 'kg_raw_graph', row_id::varchar, k, json_extract_string(j, '$."' || k || '"') from (select row_id, j, unnest(json_keys(j)) k from (select row_id, case when json_valid(head_props) and json_type(head_props) = 'OBJECT' then head_props end j from kg_raw_graph) where j is not null) where json_type(j, '$."' || k || '"') = 'VARCHAR')
      select tbl, item_id, field, {_hard("v")} hard from t where length(v) > 600""",
}
