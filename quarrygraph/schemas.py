"""Schemas of the stored relations."""

from __future__ import annotations

from functools import cache

from pyspark.sql import types as T


def _schema(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


DDL = {
    "files": "path string, abs_path string, language string, size_bytes long, last_modified timestamp, is_test boolean, is_config boolean, is_entry_point boolean, content_hash string",
    "symbols": "path string, id string, name string, qualified_name string, kind string, signature string, start_line int, end_line int, docstring string, decorators array<string>, "
    "visibility string, is_async boolean, language string, parent_name string",
    "imports": "path string, language string, raw_statement string, module_path string, imported_names array<string>, is_relative boolean",
    "nodes": "path string, node_kind string, language string, symbol_count int, has_error boolean, is_entry_point boolean, is_test boolean, pagerank double, betweenness double, content_hash string, "
    "indexed_file_at timestamp, community_id int",
    "edges": "source string, target string, imported_names array<string>, edge_type string",
    "commits": "sha string, file_path string, author string, email string, ts timestamp, is_merge boolean, subject string, added long, deleted long",
    "git_metadata": "file_path string, commit_count long, commit_count_90d long, first_commit_at timestamp, last_commit_at timestamp, age_days int, lines_added_90d long, lines_deleted_90d long, is_hotspot boolean, "
    "is_stable boolean, hotspot_score double, churn_percentile double, primary_owner string, primary_email string, contributor_count long, bus_factor int, commit_categories map<string,long>, "
    "co_change_partners array<struct<file_path:string,co_change_count:double,last_co_change:date>>",
    "dead_code": "file_path string, kind string, confidence double, reason string, safe_to_delete boolean, importers long, last_commit_at timestamp, commit_count_90d long, primary_owner string, age_days int",
    "flows": "flow_id string, entry_point string, node_count long, file_spread long, criticality double, has_test_coverage boolean",
    "flow_members": "flow_id string, path string, depth int, ord int",
    "communities": "community_id int, name string, member_count long, cohesion double, top_files array<string>",
    "community_members": "path string, community_id int",
    "refactor_previews": "preview_id string, created_at timestamp, target_name string, new_name string, kind string, edits array<struct<file:string,kind:string,old_text:string,new_text:string,source_file:string>>",
    "postings": "term string, doc string, tf long, dl long, path string",
    "meta": "key string, value string",
}

#: Version of the schemas and of the layout of a store.
VERSION = 2
#: The column that a table is dealt to buckets by.
KEYS = {"files": "path", "symbols": "path", "imports": "path", "nodes": "path", "edges": "source", "commits": "sha", "git_metadata": "file_path", "dead_code": "file_path", "flows": "flow_id", "flow_members": "flow_id", "community_members": "path", "postings": "term"}
#: Columns whose names have changed, by table and version: old name -> present name.
RENAMED = {("flow_members", 1): {"node_qualified_name": "path"}, ("community_members", 1): {"file_path": "path"}}


@cache
def schema(name: str) -> T.StructType:
    """The schema of a stored relation."""
    return _schema(DDL[name])
