"""DuckDB SQL that gives the results of the fact-checking queries from the same tables."""

from __future__ import annotations

_W = r"[\t-\r\x{85}\p{Z}]"


def _strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^\x{{FEFF}}', ''), '^{_W}+|{_W}+$', '', 'g')"


_FENCED = _strip(r"regexp_replace(payload, '(?i)^\s*```(?:json)?\s*|\s*```\s*$', '', 'g')")
_MENDED = rf"regexp_replace({_FENCED}, ',\s*([}}\]])', '\1', 'g')"
_BODY = r"regexp_replace(regexp_extract(payload, '(?s)\{.*\}'), ',\s*([}\]])', '\1', 'g')"
_P = f"p as (select distinct extraction_id, doc_id, round_no, {_BODY} body from extraction_result where payload is not null), g as (select * from p where body <> '' and json_valid(body))"
_ENT = f"{_P}, en as (select extraction_id, doc_id, round_no, unnest(json_extract(body, '$.entities[*]')) e, generate_subscripts(json_extract(body, '$.entities[*]'), 1) - 1 pos from g)"
_REL = f"{_ENT}, re as (select extraction_id, doc_id, round_no, unnest(json_extract(body, '$.relations[*]')) r, generate_subscripts(json_extract(body, '$.relations[*]'), 1) - 1 pos from g)"
_NAMES = "nm as (select extraction_id, e->>'id' id, arg_max(struct_pack(n := e->>'name'), pos).n \"name\" from en where e->>'id' is not null group by all)"


def _list(x: str) -> str:
    return f"case when (r->'{x}') is null or json_type(r->'{x}') = 'NULL' then [] when json_type(r->'{x}') = 'ARRAY' then list_filter(json_extract_string(r, '$.{x}[*]'), lambda y: y is not null) else [(r->>'{x}')] end"


_ENDS = f"ex as (select extraction_id, pos, r, unnest({_list('source')}) source, {_list('target')} t from re), ed as (select extraction_id, pos, r, source, unnest(t) target from ex)"
_TRIPLES = f"{_REL}, {_NAMES}, tr as (select re.extraction_id, re.doc_id, re.round_no, re.pos, h.name head, r->>'relation' relation, t.name tail from re join nm h on h.extraction_id = re.extraction_id and h.id = r->>'source' join nm t on t.extraction_id = re.extraction_id and t.id = r->>'target' where h.name <> '' and t.name <> '' and r->>'relation' <> '')"
_ATTR = "case when json_type({0}->'attributes') = 'OBJECT' then ({0}->'attributes')::varchar when json_type({0}->'attributes') = 'VARCHAR' and json_valid({0}->>'attributes') and json_type({0}->>'attributes') = 'OBJECT' then {0}->>'attributes' else '{{}}' end"


def _over(key: str, known: str) -> str:
    return f"case when list_contains(json_keys(atr), '{key}') then atr->>'{key}' else {known} end"


_EDGES = f"""le as (select ed.extraction_id, pos, source, target, {_ATTR.format('r')} atr, coalesce(a.name, '') sn, coalesce(r->>'relation', r->>'type', 'RELATED_TO') re, coalesce(b.name, '') tn, coalesce(r->>'evidence', '') ev
      from ed left join nm a on a.extraction_id = ed.extraction_id and a.id = source left join nm b on b.extraction_id = ed.extraction_id and b.id = target),
  eg as (select extraction_id, pos, source, target, atr, {_over('source_name', 'sn')} source_name, {_over('relation', 're')} relation, {_over('target_name', 'tn')} target_name, {_over('evidence', 'ev')} evidence from le)"""
_NODES = "cn as (select name, max_by(struct_pack(i := id, t := type, p := props, d := deleted_at), struct_pack(a := loaded_at, b := id, c := type, d := deleted_at is null)) l from entity where name is not null group by name), nd as (select name, l.i id, l.t \"type\", l.p props from cn where l.d is null)"
_UNIT = "u as (select row_id, embedding::double[] v, sqrt(list_dot_product(embedding::double[], embedding::double[])) n from kg_vectors where embedding is not null and len(embedding) > 0)"


def _topk(rows: str, extra: str = "") -> str:
    return f"""with v as ({rows}), s as (select q.id q_id, r.id r_id, list_dot_product(q.v, r.v) / (q.n * r.n) sim from v q, v r where q.id % 20 = 0 {extra}),
      k as (select *, row_number() over (partition by q_id order by sim desc, r_id desc) rank from s)"""


_EMB = "select vec_id id, embedding::double[] v, sqrt(list_dot_product(embedding::double[], embedding::double[])) n from embeddings"
_KGV = "select * from (select row_id id, embedding::double[] v, sqrt(list_dot_product(embedding::double[], embedding::double[])) n from kg_vectors where embedding is not null and len(embedding) > 0) where n > 0"


def _props(col: str) -> str:
    return f"case when json_valid({col}) and json_type({col}) = 'OBJECT' then {col} else '{{}}' end"


def _value(j: str, k: str) -> str:
    return f"json_extract_string({j}, '$.\"' || {k} || '\"')"


def _shown(j: str) -> str:
    return f"coalesce(array_to_string(list_transform(list_filter(json_keys({j}), lambda k: k not in ('id', 'doc_id', 'name') and {_value(j, 'k')} is not null), lambda k: k || ':' || {_value(j, 'k')}), '；'), '')"


_SENT = f"""kp as (select row_id, head, relation, tail, {_props('head_props')} h, {_props('rel_props')} r, {_props('tail_props')} t from kg_raw_graph),
  ks as (select *, {_shown('h')} hs, {_shown('t')} ts, coalesce(nullif(r->>'date', ''), nullif(r->>'time', '')) w from kp),
  sent as (select row_id, coalesce(r->>'doc_id', '') doc, '1. ' || head || '（' || case when hs = '' then '主體' else hs end || '） 透過關係【' || relation || '】與 ' || tail || '（' || case when ts = '' then '受體' else ts end || '） 建立連結，說明：'
    || case when list_contains(json_keys(r), 'evidence') then coalesce(r->>'evidence', '') else relation end || case when w is not null then '；事件時間：' || w else '' end || '。' line from ks)"""
_PARTS = r"string_split_regex(line, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]')"
_LINES = f"{_SENT}, sp as (select row_id, doc, case when {_PARTS}[-1] = '' then {_PARTS}[:-2] else {_PARTS} end parts from sent), ln as (select row_id, doc, unnest(parts) line, generate_subscripts(parts, 1) - 1 line_no from sp), nb as (select *, row_number() over (partition by doc order by row_id, line_no) n from ln)"
_BUCKETS = "b as (select vec_id - vec_id % 100 doc, label bucket, vec_id seq, coalesce(d.text, '') line, embedding::double[] vec, row_number() over (partition by vec_id - vec_id % 100, label order by vec_id) i from embeddings e left join documents d on d.doc_id = e.vec_id)"
_SIM = "list_dot_product(k.vec, b.vec) / (sqrt(list_dot_product(k.vec, k.vec)) * sqrt(list_dot_product(b.vec, b.vec))) >= 0.2"
_FOLD = "select doc, bucket, unnest(kept) x from (select *, row_number() over (partition by doc, bucket order by i desc) z from f) where z = 1"

SQL = {
    "scan_project": "select row_id, head, relation, tail from kg_raw_graph where head <> '' and tail <> ''",
    "document_scan": f"select doc_id, {_strip('text')} \"text\" from documents",
    "first_document": "select doc_id, text from news_in order by doc_id, text nulls first limit 1",
    "id_from_path": "select distinct doc_id from news_in",
    "vector_normalize": f"with {_UNIT} select row_id, round(v[1] / n, 6) \"first\", round(v[-1] / n, 6) \"last\", round(sqrt(list_sum(list_transform(v, lambda x: (x / n) * (x / n)))), 6) length from u where n > 0",
    "cosine_pairs": f"with {_UNIT} select a.row_id, round(list_dot_product(a.v, b.v) / (a.n * b.n), 6) sim from u a join u b on b.row_id = a.row_id + 1 where a.n > 0 and b.n > 0",
    "vector_topk": f"{_topk(_EMB)} select q_id, r_id, round(sim, 6) sim, rank::int rank from k where rank <= 100",
    "vector_topk_threshold": f"{_topk(_EMB)} select q_id, r_id, round(sim, 6) sim, rank::int rank from k where rank <= 100 and sim >= 0.3",
    "vector_search": f"{_topk(_KGV)} select q_id, r_id, round(sim, 6) sim, rank::int rank from k where rank <= 100 and sim >= 0.8",
    "hybrid_search": f"{_topk(_KGV)} select q_id, r_id, round(sim, 6) sim, rank::int rank from k join kg_raw_graph a on a.row_id = q_id join kg_raw_graph b on b.row_id = r_id where rank <= 100 and sim >= 0.8 and (a.head = b.head or a.tail = b.tail)",
    "dedup_keep_first": f"""with recursive {_BUCKETS}, f as (
      select doc, bucket, i, [struct_pack(seq := seq, vec := vec)] kept from b where i = 1
      union all select b.doc, b.bucket, b.i, case when len(list_filter(f.kept, lambda k: {_SIM})) > 0 then f.kept else list_append(f.kept, struct_pack(seq := b.seq, vec := b.vec)) end
      from f join b on b.doc = f.doc and b.bucket = f.bucket and b.i = f.i + 1)
      select doc, bucket, x.seq seq from ({_FOLD})""",
    "dedup_keep_longest": f"""with recursive {_BUCKETS}, f as (
      select doc, bucket, i, [struct_pack(seq := seq, n := length(line), vec := vec)] kept from b where i = 1
      union all select doc, bucket, i, case when h is null then list_append(kept, struct_pack(seq := seq, n := n, vec := vec))
        else list_transform(kept, lambda k, j: case when j = h and n > k.n then struct_pack(seq := k.seq, n := n, vec := vec) else k end) end
      from (select b.doc, b.bucket, b.i, b.seq, length(b.line) n, b.vec, f.kept, list_position(list_transform(f.kept, lambda k: {_SIM}), true) h
        from f join b on b.doc = f.doc and b.bucket = f.bucket and b.i = f.i + 1))
      select doc, bucket, x.seq seq, x.n::bigint n_chars from ({_FOLD})""",
    "mean_pool": "select label, (i - 1)::int dim, round(avg(x), 6) mean from (select label, unnest(embedding::double[]) x, generate_subscripts(embedding, 1) i from embeddings) group by all",
    "sliding_chunks": "select doc_id, (start // 256)::int chunk_no, start::int start, substr(text, start::int + 1, 510) chunk from (select doc_id, text, unnest(range(0, greatest(0, ceil((length(text) - 510) / 256.0))::int * 256 + 1, 256)) start from documents where length(text) > 0)",
    "clean_json_fence": f"select distinct extraction_id, {_FENCED} payload from extraction_result",
    "safe_json": rf"select distinct extraction_id, case when json_valid({_FENCED}) and not regexp_matches({_FENCED}, ',\s*[}}\]]') then {_FENCED} when json_valid({_MENDED}) then {_MENDED} end payload from extraction_result",
    "json_props": f"with p as (select row_id, {_props('rel_props')} r from kg_raw_graph) select row_id, r->>'doc_id' doc_id, r->>'date' \"date\", len(json_keys(r))::bigint n_props from p",
    "entity_nodes": f"""with {_ENT}, a as (select *, case when json_type(e->'attributes') = 'OBJECT' then (e->'attributes')::varchar when json_type(e->'attributes') = 'VARCHAR' and json_valid(e->>'attributes') and json_type(e->>'attributes') = 'OBJECT' then e->>'attributes' else '{{}}' end atr from en)
      select extraction_id, pos::int pos, coalesce(atr->>'id', e->>'id') id, coalesce(atr->>'name', e->>'name') "name", coalesce(atr->>'type', e->>'type', 'Entity') "type", len(list_filter(json_keys(atr), lambda k: k not in ('id', 'name', 'type')))::bigint n_props from a""",
    "relation_expand": f"with {_REL}, {_ENDS} select extraction_id, pos::int pos, source, target from ed",
    "relation_edges": f"with {_REL}, {_NAMES}, {_ENDS}, {_EDGES} select extraction_id, pos::int pos, source_name, relation, target_name, evidence from eg",
    "valid_edges": "select distinct edge_id, source_name, relation, target_name from relationships where source_name <> '' and target_name <> '' and evidence <> ''",
    "resolve_triples": f"with {_TRIPLES} select extraction_id, pos::int pos, head, relation, tail from tr",
    "normalize_triples": "select distinct edge_id, nullif(source_name, '') head, relation, nullif(target_name, '') tail from relationships where source_name <> '' and target_name <> '' and relation is not null union all select row_id, head, relation, tail from kg_raw_graph where head is not null and relation is not null and tail is not null",
    "question_triples": "select row_id, head, relation, coalesce(case when row_id % 3 > 0 then tail end, '未知') tail from kg_raw_graph where head <> '' and relation <> ''",
    "merge_triples": f"with {_TRIPLES}, m as (select doc_id, head, relation, tail, min(struct_pack(a := round_no, b := extraction_id, c := pos)) o from tr group by all) select doc_id, head, relation, tail, row_number() over (partition by doc_id order by o)::int seq from m",
    "triple_counts": "select relation, count(*) n, count(distinct head) n_heads from kg_raw_graph group by relation",
    "edge_evidence_count": "select source_name, target_name, evidence, count(*) n from relationships where source_name <> '' and target_name <> '' and evidence <> '' group by all",
    "node_upsert": f"""with l as (select head "name", {_props('head_props')} p, row_id, case when feed = 'taipei_desk' then 0 else 1 end t from kg_raw_graph where feed is not null and head is not null),
      m as (select "name", arg_min(struct_pack(i := p->>'id', y := p->>'type'), struct_pack(t := t, s := row_id)) x from l group by "name"),
      kv as (select "name", unnest(json_keys(p)) k, p, t, row_id from l), la as (select "name", k, arg_max(struct_pack(v := {_value('p', 'k')}), struct_pack(t := t, s := row_id)).v v from kv where k not in ('id', 'type') group by all)
      select m.name "name", x.i id, x.y "type", coalesce(string_agg(k || ':' || v, '|' order by k), '') props from m left join (select * from la where v is not null) la on la.name = m.name group by all""",
    "edge_dedup_load": """with n as (select * from relationships where loaded_at >= '2024-07-01' and source_name <> '' and target_name <> '' and evidence <> '' and relation <> ''), o as (select * from relationships where loaded_at < '2024-07-01'),
      f as (select source_name, target_name, evidence, min(edge_id) edge_id from n group by all)
      select edge_id from f where not exists (select 1 from o where o.source_name = f.source_name and o.target_name = f.target_name and o.evidence = f.evidence) and source_name in (select name from entity) and target_name in (select name from entity)""",
    "graph_export": f"""with {_NODES}, e as (select distinct edge_id, source_name, relation, target_name, "date" from relationships)
      select source_name head, relation, target_name tail, "date", a.type head_type, b.id tail_id from e join nd a on a.name = source_name join nd b on b.name = target_name""",
    "first_json_object": r"""with p as (select distinct extraction_id, payload, substr(payload, strpos(payload, '{')) t from extraction_result),
      c as (select extraction_id, payload, t, case when contains(payload, '{') then regexp_extract_all(t, '[^{}]*[{}]') else [] end s from p),
      g as (select *, list_position(list_transform(range(1, len(s) + 1), lambda i: list_sum(list_transform(s[1:i], lambda x: case when x like '%{' then 1 else -1 end)) = 0), true) k from c)
      select extraction_id, case when k > 0 then substr(t, 1, length(array_to_string(s[1:k], ''))) end payload from g""",
    "extract_json_block": r"""with p as (select distinct extraction_id, payload, substr(payload, strpos(payload, '{')) t from extraction_result),
      c as (select extraction_id, payload, t, case when contains(payload, '{') then regexp_extract_all(t, '[^{}]*[{}]') else [] end s from p),
      g as (select *, list_position(list_transform(range(1, len(s) + 1), lambda i: list_sum(list_transform(s[1:i], lambda x: case when x like '%{' then 1 else -1 end)) = 0), true) k from c),
      f as (select extraction_id, coalesce(nullif(regexp_extract(payload, '(?is)```json\s*(\{.*?\})\s*```', 1), ''), case when k > 0 then substr(t, 1, length(array_to_string(s[1:k], ''))) end) x from g)
      select extraction_id, case when json_valid(x) and not regexp_matches(x, ',\s*[}\]]') then x end payload from f""",
    "asked_triples": rf"""with {_TRIPLES}, u as (select extraction_id, {_FENCED} f, {_MENDED} m from extraction_result)
      select distinct doc_id, head, relation, tail from tr where doc_id in (select doc_id from news_in) and (round_no = 2 or extraction_id in (select extraction_id from u where json_valid(f) and not regexp_matches(f, ',\s*[}}\]]') or json_valid(m)))""",
    "unreadable_rounds": rf"""with u as (select distinct doc_id, round_no, payload raw, {_FENCED} f, {_MENDED} m from extraction_result where doc_id in (select doc_id from news_in))
      select doc_id, round_no, raw, case when coalesce(trim(raw), '') = '' then 'EMPTY' else 'NOT_JSON' end reason from u where raw is null or not ((json_valid(f) and not regexp_matches(f, ',\s*[}}\]]')) or json_valid(m))""",
    "build_graph_edges": f"""with {_REL}, {_NAMES}, {_ENDS}, {_EDGES}, {_NODES},
      w as (select eg.*, coalesce(atr->>'doc_id', p.doc_id) doc_id, atr->>'date' "date", row_number() over (partition by source_name, target_name, evidence order by eg.extraction_id, p.doc_id, pos, source, target) k from eg join (select distinct extraction_id, doc_id from p) p on p.extraction_id = eg.extraction_id where source_name <> '' and target_name <> '' and evidence <> '' and relation <> ''),
      ea as (select {_over("name", "e->>'name'")} "name" from (select e, {_ATTR.format('e')} atr from en)), kn as (select "name" from ea where "name" is not null union select "name" from nd)
      select source_name, target_name, relation, evidence, doc_id, "date" from w where k = 1 and source_name in (select "name" from kn) and target_name in (select "name" from kn) and not exists (select 1 from relationships o where o.source_name = w.source_name and o.target_name = w.target_name and o.evidence = w.evidence)""",
    "build_graph_nodes": f"""with {_ENT}, {_NODES}, ea as (select extraction_id s, doc_id d, pos, e, {_ATTR.format('e')} atr from en),
      lg as (select 1 t, s, d, pos, atr, {_over("name", "e->>'name'")} "name", {_over("id", "e->>'id'")} id, {_over("type", "coalesce(e->>'type', 'Entity')")} "type" from ea),
      al as (select 0 t, null::bigint s, null::varchar d, null::bigint pos, null::json atr, "name", id, "type", props from nd union all select t, s, d, pos, atr, "name", id, "type", null from lg where "name" is not null),
      fi as (select *, row_number() over (partition by "name" order by t, s, d, pos) k from al),
      kv as (select "name", t, s, d, pos, unnest(map_keys(props)) k, unnest(map_values(props)) v from al where t = 0 union all select "name", t, s, d, pos, k, json_extract_string(atr, '$."' || k || '"') from (select *, unnest(list_filter(json_keys(atr), lambda k: k not in ('id', 'name', 'type'))) k from al where t = 1)),
      la as (select "name", k, v, row_number() over (partition by "name", k order by t desc, s desc, d desc, pos desc) z from kv)
      select "name", id, "type", (select count(*) from la where la.name = fi.name and z = 1 and v is not null) n_props from fi where k = 1""",
    "sub_questions": f"""with q as (select doc_id, list_filter(list_transform(string_split_regex("text", '[？?。]'), lambda x: {_strip('x')}), lambda x: x <> '') q from documents where doc_kind = 'question' and "text" is not null)
      select doc_id, unnest(range(len(q)))::int pos, unnest(q) question from q""",
    "answer_faults": f"""with {_REL}, {_ENDS}, own as (select extraction_id, pos, e->>'id' id, e->>'name' "name" from en)
      select extraction_id, 'repeated_id' fault, pos::int pos from own o where exists (select 1 from own x where x.extraction_id = o.extraction_id and x.id = o.id and x.pos < o.pos)
      union all select extraction_id, 'no_name', pos::int from own where coalesce("name", '') = ''
      union all select extraction_id, 'several_targets', pos::int from re where regexp_matches(coalesce(case when json_type(r->'target') = 'NULL' then null else r->>'target' end, ''), '^\\[|[,、]')
      union all select extraction_id, 'no_evidence', pos::int from re where coalesce(r->>'evidence', '') = ''
      union all select distinct extraction_id, 'unknown_end', pos::int from (select extraction_id, pos, unnest(list_concat({_list('source')}, {_list('target')})) x from re) u where not exists (select 1 from own where own.extraction_id = u.extraction_id and own.id = u.x)""",
    "decode_upload": "select doc_id, \"text\" from documents where \"text\" is not null",
    "resolve_document": "select '/in/' || max(doc_id) || '.txt' path from news_in",
    "triples_round_trip": "select nullif(head, '') head, nullif(relation, '') relation, nullif(tail, '') tail, nullif(head_props, '') head_props, nullif(rel_props, '') rel_props, nullif(tail_props, '') tail_props from kg_raw_graph",
    "embed_graph": "select row_id r_id, 64 \"size\" from kg_raw_graph",
    "token_chunks": r"""with t as (select doc_id, "text", regexp_extract_all("text", '[\t-\r\x{85}\p{Z}]*\p{Han}|[\t-\r\x{85}\p{Z}]*[^\t-\r\x{85}\p{Z}\p{Han}]+|[\t-\r\x{85}\p{Z}]+$') t from documents where length("text") > 0),
      c as (select *, unnest(range(0, greatest(0, ceil((len(t) - 510) / 256.0))::int + 1)) n from t where len(t) > 0)
      select doc_id, n::int chunk_no, len(t[n * 256 + 1:n * 256 + 510])::int n_tokens, case when len(t) <= 510 then "text" else array_to_string(t[n * 256 + 1:n * 256 + 510], '') end chunk from c""",
    "verdict_points": r"""with e as (select distinct edge_id, source_name a, target_name b from relationships where not regexp_matches(source_name, '[\n\r]') and not regexp_matches(target_name, '[\n\r]'))
      select edge_id::varchar doc_id, 'consistent' "label", 1 item_no, '甲' || a || '；`[1]`[2][2]' "text", case when edge_id % 7 = 0 then '1' else '1,2' end cited from e
      union all select edge_id::varchar, 'contradictory', 2, '乙' || b || '；`[9]`', '' from e""",
    "verdict_scores": r"select distinct edge_id::varchar doc_id, (edge_id % 7 + 5)::int score from relationships where edge_id % 7 < 6 and not regexp_matches(source_name, '[\n\r]') and not regexp_matches(target_name, '[\n\r]') union all select distinct edge_id::varchar, null from relationships where edge_id % 7 = 6 and not regexp_matches(source_name, '[\n\r]') and not regexp_matches(target_name, '[\n\r]')",
    "format_props": f"with p as (select row_id, {_props('tail_props')} t from kg_raw_graph) select row_id, {_shown('t')} shown from p",
    "verbalize": f"with {_SENT} select row_id, line from sent",
    "split_lines": f"with {_LINES} select row_id, line_no::int line_no, line from ln",
    "triple_text": "select row_id, coalesce(head, '') || ' ' || coalesce(relation, '') || ' ' || coalesce(tail, '') \"text\" from kg_raw_graph",
    "entity_key_full": rf"with {_SENT} select row_id, coalesce(nullif(regexp_extract(line, '^\d+\.{_W}*(.+?){_W}*透過關係', 1), ''), string_split(line, ' ')[1]) bucket from sent",
    "entity_key_name": rf"with {_SENT} select row_id, coalesce(nullif(regexp_extract(line, '^\d+\.{_W}*([^\t-\r\x{{85}}\p{{Z}}（]+)', 1), ''), regexp_extract(line, '[^\t-\r\x{{85}}\p{{Z}}]+')) bucket from sent",
    "renumber_lines": rf'''with {_LINES} select doc, n::int n, regexp_replace(line, '^\d+\.', '[' || n || ']') "text", '[' || n || '] ' || regexp_replace(line, '^{_W}*(?:\[\d+\]\.?|\d+\.){_W}*', '') prefixed from nb''',
    "report_assembly": rf'''with {_LINES}, r as (select doc, string_agg(regexp_replace(line, '^\d+\.', '[' || n || ']'), chr(10) order by n) k from nb group by doc), d as (select distinct doc_id, coalesce(text, '') "text" from news_in) select doc, '```' || chr(10) || '[原始新聞]' || chr(10) || d.text || chr(10) || '```' || chr(10) || '```' || chr(10) || '[比對知識]' || chr(10) || k || chr(10) || '```' report from r join d on d.doc_id = doc''',
    "parse_request_date": r"""select distinct edge_id, case when regexp_full_match("date", '\d{4}/\d{1,2}/\d{1,2}') then strftime(try_strptime("date", '%Y/%m/%d'), '%Y-%m-%d') end "day" from relationships""",
    "merge_date_text": "select distinct doc_id, '新聞日期：' || strftime(published_at, '%Y-%m-%d') || '。' || coalesce(text, '') \"text\" from news_in",
    "run_id_format": "select distinct doc_id, strftime(published_at, '%Y-%m-%d') || '_' || strftime(loaded_at + interval 8 hour, '%Y-%m-%d_%H%M') run_id from news_in",
    "validate_requests": r"select doc_id, case when coalesce(text, '') = '' then 'NO_TEXT' when coalesce(source, '') = '' then 'NO_DATE' when doc_kind = 'question' and not regexp_matches(text, '^https?://.+\..+') then 'NO_URL' else 'OK' end status from documents",
    "parse_label": "select doc_id, case when lang = 'en' then n_chars when doc_id % 2 = 0 and lang is not null then (lower(lang) in ('1', 'yes', 'true'))::int else (coalesce(source, 'Fake_News') = 'Fake_News')::int end::bigint \"label\" from documents",
    "incremental_anti": "select distinct doc_id from news_in where doc_id not in (select doc_id from extraction_result where doc_id is not null)",
    "pipeline_status": f"with {_TRIPLES} select distinct doc_id, case when doc_id not in (select doc_id from tr where doc_id is not null) then 'NO_TRIPLES' when doc_id not in (select doc_id from relationships where doc_id is not null) then 'NO_HITS' else 'OK' end status from news_in",
}
