"""Queries of the scalar functions over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..sources.tables import table
from . import base

_SPLIT = r"regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')"


def _split(x: str) -> str:
    return _SPLIT.format(x=x)


def _toks(x: str) -> str:
    return f"list_filter(string_split_regex(lower({_split(x)}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: length(t) >= 2)"


def _djb2(x: str) -> str:
    return f"list_reduce(list_prepend(5381::bigint, list_transform(string_split({x}, ''), lambda c: ord(c)::bigint)), lambda a, b: (a * 33 + b) % 4294967296)"


_S = "with " + base.SYM
_EP = "lower(regexp_replace('/' || regexp_replace(regexp_replace(regexp_replace({x}, '[\"''`]', '', 'g'), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*', ''), '[?#].*$', ''), '/+', '/', 'g'))"


def _names(s, d):
    return base.symbols(s, d).select("repo_id", "symbol_id", "name", "signature", "file_path", "kind")


QUERIES = {
    "fn_stable_id": lambda s, d: _names(s, d).select("repo_id", "symbol_id", fn.stable_id(F.concat_ws(":", "repo_id", "file_path", "kind", "name")).alias("id")),
    "fn_norm_path": lambda s, d: table(s, d, "files").select("repo_id", "path", fn.norm_path(F.col("path")).alias("norm")).distinct(),
    "fn_is_test_path": lambda s, d: base.files(s, d).groupBy(fn.is_test_path(F.col("path")).alias("is_test")).agg(F.count(F.lit(1)).alias("n")),
    "fn_is_migration": lambda s, d: _names(s, d).groupBy(fn.is_migration(F.col("file_path"), F.col("name")).alias("migration")).agg(F.count(F.lit(1)).alias("n")),
    "fn_split_case": lambda s, d: _names(s, d).select("name", fn.split_case(F.col("name")).alias("parts")).distinct(),
    "fn_intent_tokens": lambda s, d: _names(s, d).where("signature is not null").select("signature", F.array_join(fn.intent_tokens(F.col("signature")), " ").alias("tokens")).distinct(),
    "fn_normalize_symbol": lambda s, d: _names(s, d).select("repo_id", "symbol_id", fn.normalize_symbol(F.col("name"), F.col("signature")).alias("text")),
    "fn_strip_generics": lambda s, d: _names(s, d).where("signature is not null").select("signature", fn.strip_generics(F.col("signature")).alias("bare")).distinct(),
    "fn_djb2": lambda s, d: _names(s, d).select("name", fn.djb2(F.col("name")).alias("h")).distinct(),
    "fn_trigram_vector": lambda s, d: _names(s, d).select("name").distinct().select("name", F.explode(fn.trigram_buckets(F.lower(fn.split_case(F.col("name"))))).alias("bucket")).groupBy("name", "bucket").agg(F.count(F.lit(1)).alias("n")),
    "fn_l2_distance": lambda s, d: table(s, d, "embeddings").select("vec_id", F.round(fn.l2(F.col("embedding").cast("array<double>"), F.transform("embedding", lambda x: F.lit(0.0))), 5).alias("norm")),
    "fn_levenshtein": lambda s, d: table(s, d, "nation").alias("a").join(table(s, d, "region").alias("b"), F.col("a.n_regionkey") == F.col("b.r_regionkey")).select("n_name", "r_name", F.levenshtein("n_name", "r_name").cast("bigint").alias("distance"), F.round(fn.similarity(F.col("n_name"), F.col("r_name")), 6).alias("similarity")),
    "fn_dice_bigrams": lambda s, d: table(s, d, "part").select("p_name", "p_type").distinct().select("p_name", "p_type", F.round(fn.dice(F.lower("p_name"), F.lower("p_type")), 6).alias("dice")),
    "fn_convention_key": lambda s, d: _names(s, d).select("name", fn.convention_key(F.col("name")).alias("key"), fn.convention_stem(F.col("name")).alias("stem")).distinct(),
    "fn_singular_plural": lambda s, d: _names(s, d).select(F.lower("name").alias("w")).distinct().select("w", fn.singular(F.col("w")).alias("one"), fn.plural(F.col("w")).alias("many")),
    "fn_fold_diacritics": lambda s, d: table(s, d, "documents").select("doc_id", F.md5(fn.fold_diacritics(F.lower("text"))).alias("h")),
    "fn_non_ascii_letters": lambda s, d: table(s, d, "documents").select("doc_id", fn.non_ascii_letters(F.col("text")).cast("bigint").alias("n")),
    "fn_norm_endpoint": lambda s, d: table(s, d, "repositories").select("repo_path", fn.norm_endpoint(F.concat(F.lit("'https://host.example/API//"), "repo_path", F.lit("?q=1#top'"))).alias("endpoint")),
    "fn_combine_route": lambda s, d: _names(s, d).where("kind = 'class'").select("name", fn.combine_route(F.lit("api/[controller]"), F.lit("/[action]/{id}"), F.lower("name"), F.lit("get")).alias("route")).distinct(),
    "fn_param_count": lambda s, d: _names(s, d).where("signature is not null").select("signature", fn.param_count(F.col("signature")).cast("bigint").alias("n")).distinct(),
    "fn_sql_name_key": lambda s, d: table(s, d, "audit_log").select("target_table").where("target_table is not null").distinct().select("target_table", fn.sql_name_key(F.col("target_table")).alias("key")),
    "fn_edge_confidence": lambda s, d: base.edges(s, d).select("type", fn.edge_confidence(F.col("to_id"), F.col("type")).alias("c")).groupBy("type", "c").agg(F.count(F.lit(1)).alias("n")),
    "fn_epoch_to_iso": lambda s, d: table(s, d, "events").select("event_id", F.date_format(fn.epoch_to_timestamp(F.unix_seconds(F.col("ts").cast("timestamp")) * F.element_at(F.array(F.lit(1), F.lit(1000), F.lit(1000000), F.lit(1000000000)), (F.pmod("event_id", F.lit(4)) + 1).cast("int"))), "yyyy-MM-dd HH:mm:ss").alias("iso")),
    "fn_duration_ms": lambda s, d: table(s, d, "ddl_history").select("id", F.round(fn.duration_ms(F.col("duration_ms") * 1000.0), 3).alias("ms")).distinct(),
    "fn_namespace": lambda s, d: table(s, d, "audit_log").where("target_table is not null").groupBy(fn.namespace_root(F.col("target_table"), 1).alias("root"), fn.classify_namespace(F.col("target_table"), ["app."], ["public."]).alias("class")).agg(F.count(F.lit(1)).alias("n")),
    "fn_redact": lambda s, d: table(s, d, "ddl_history").select(fn.redact(F.concat(F.lit("pg://u:pw@h/"), F.col("applied_by"), F.lit(" token=abc "), F.col("applied_by"), F.lit("@mail.example"))).alias("x")).distinct(),
    "fn_json_normalize": lambda s, d: table(s, d, "ddl_history").select("id", fn.json_normalize({"version": F.col("version"), "kind": F.col("kind"), "direction": F.col("direction")}).alias("j")).distinct(),
    "fn_bytes_hex": lambda s, d: table(s, d, "nation").select("n_name", fn.bytes_hex(F.encode("n_name", "UTF-8")).alias("h")),
}

SQL = {
    "fn_stable_id": _S + " select repo_id, symbol_id, substr(sha256(repo_id || ':' || file_path || ':' || kind || ':' || name), 1, 24) as id from sym",
    "fn_norm_path": "select distinct repo_id, path, replace(path, '\\', '/') as norm from files",
    "fn_is_test_path": "with " + base.FIL + f" select {base.test_sql('path')} as is_test, count(*) as n from fil group by 1",
    "fn_is_migration": _S + r" select regexp_matches(regexp_extract(file_path, '([^/]*)$', 1), '^\d{8,}_') or (name in ('Up', 'Down') and regexp_matches(file_path, '(?i)migration')) as migration, count(*) as n from sym group by 1",
    "fn_split_case": _S + f" select distinct name, {_split('name')} as parts from sym",
    "fn_strip_generics": _S + " select distinct signature, regexp_replace(signature, '<[^>]*>', '', 'g') as bare from sym where signature is not null",
    "fn_normalize_symbol": _S + ", t as (select repo_id, symbol_id, trim(lower(regexp_replace(" + _split("regexp_replace(regexp_replace(name, '^[a-z]+:', ''), '<[^>]*>', '', 'g')") + ", '[^A-Za-z0-9]+', ' ', 'g'))) as a, trim(lower(regexp_replace(" + _split("regexp_replace(coalesce(signature, ''), '<[^>]*>', '', 'g')") + ", '[^A-Za-z0-9]+', ' ', 'g'))) as b from sym) select repo_id, symbol_id, trim(a || ' ' || b) as text from t",
    "fn_djb2": _S + f" select distinct name, {_djb2('name')} as h from sym",
    "fn_trigram_vector": _S + ", w as (select distinct name, unnest(list_filter(string_split(lower(" + _split("name") + "), ' '), lambda t: length(t) >= 2)) as w, generate_subscripts(list_filter(string_split(lower(" + _split("name") + "), ' '), lambda t: length(t) >= 2), 1) as i from sym), g as (select name, case when length(w) < 3 then [w] else list_transform(range(1, length(w) - 1), lambda k: substr(w, k, 3)) end as gs from w), x as (select name, unnest(gs) as g from g) select name, cast(" + _djb2("g") + " % 512 as integer) as bucket, count(*) as n from x group by 1, 2",
    "fn_l2_distance": "select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 5) as norm from embeddings",
    "fn_levenshtein": "select n_name, r_name, levenshtein(n_name, r_name) as distance, round(case when lower(n_name) = lower(r_name) then 1.0 else 1 - levenshtein(lower(n_name), lower(r_name)) / greatest(length(n_name), length(r_name))::double end, 6) as similarity from nation join region on n_regionkey = r_regionkey",
    "fn_convention_key": _S + " select distinct name, lower(regexp_replace(name, '[_\\-]', '', 'g')) as key, regexp_replace(lower(regexp_replace(name, '[_\\-]', '', 'g')), '(es|s)$', '') as stem from sym",
    "fn_singular_plural": _S + ", w as (select distinct lower(name) as w from sym) select w, case when w like '%ies' then regexp_replace(w, 'ies$', 'y') when w like '%ses' then regexp_replace(w, 'es$', '') when regexp_matches(w, '[^s]s$') then regexp_replace(w, 's$', '') else w end as one, case when regexp_matches(w, '[^aeiou]y$') then regexp_replace(w, 'y$', 'ies') when regexp_matches(w, '(s|x|z|ch|sh)$') then w || 'es' else w || 's' end as many from w",
    "fn_norm_endpoint": "select repo_path, " + _EP.format(x="'''https://host.example/API//' || repo_path || '?q=1#top'''") + " as endpoint from repositories",
    "fn_combine_route": _S + " select distinct name, regexp_replace('api/' || lower(name) || '/' || '/get/{id}', '/+', '/', 'g') as route from sym where kind = 'class'",
    "fn_sql_name_key": "select distinct target_table, case when contains(target_table, '.') then (case when split_part(lower(target_table), '.', 1) = 'public' then '' else split_part(lower(target_table), '.', 1) end) || '|' || substr(lower(target_table), strpos(target_table, '.') + 1) else '|' || lower(target_table) end as key from audit_log where target_table is not null",
    "fn_edge_confidence": "select type, case when to_id like 'callee:%' then 0.4 when to_id like 'import:%' then 0.5 when to_id like 'type:%' then 0.45 when to_id like 'property:%' then 0.5 when type = 'CALLS' then 1.0 when type = 'IMPORTS' then 0.95 when type = 'TYPE_REF' then 0.9 when type = 'PROPERTY_REF' then 0.85 when type = 'PROPERTY_WRITE' then 0.82 else 1.0 end::double as c, count(*) as n from edges group by 1, 2",
    "fn_epoch_to_iso": "select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as iso from events",
    "fn_duration_ms": "select distinct id, round(duration_ms::double, 3) as ms from ddl_history",
    "fn_namespace": "select split_part(target_table, '.', 1) as root, case when target_table like 'app.%' then 'app' when target_table like 'public.%' then 'framework' else 'unclassified' end as class, count(*) as n from audit_log where target_table is not null group by 1, 2",
    "fn_redact": "select distinct 'pg://***@h/' || applied_by || ' token=*** ***@***' as x from ddl_history",
    "fn_bytes_hex": "select n_name, '0x' || lower(hex(n_name)) as h from nation",
}
