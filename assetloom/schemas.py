"""Schemas of the public tables; nothing is inferred."""

from __future__ import annotations

OBSERVATION = "struct<key:string,url:string,method:string,referer:string,first_seen:string,last_seen:string,count:bigint,status_code:int,content_type:string>"

CAPTURES = "capture_id bigint, url string, method string, status_code int, content_type string, headers array<string>, referer string, host string, path string, body binary, ts string"

INDEX_FIELDS = {
    "url": "string", "method": "string", "status_code": "int", "timestamp": "string", "content_type": "string", "asset_type": "string", "referer": "string", "host": "string", "path": "string",
    "original_filename": "string", "sha256": "string", "sourcemap_ref": "string", "raw_path": "string", "beautified_path": "string", "sourcemap_path": "string", "resolved_dir": "string",
    "html_path": "string", "script_srcs": "array<string>", "inline_script_count": "int", "discovered_from": "string", "chunk_candidates": "array<string>", "first_seen": "string", "last_seen": "string",
    "seen_count": "bigint", "observations": f"array<{OBSERVATION}>",
}
ENTRY = "struct<" + ",".join(f"{k}:{v}" for k, v in INDEX_FIELDS.items()) + ">"

FINDINGS = "asset_id string, pos bigint, file_path string, kind string, bucket string, label string, detail string, line int, col int, meta map<string,string>, ord bigint"

#: Buckets of findings, in the order of the exports.
BUCKETS = (
    "endpoints", "fetch_options", "rest_client", "window_open", "urlsearchparams", "paths", "urls", "hostnames", "extensions", "mime_types", "regexes", "graphql", "schemas", "data", "secrets",
    "sinks", "user_sinks", "events", "location", "storage", "cookies", "document_domain", "window_name", "dependencies", "frameworks", "feature_flags", "signatures",
)
