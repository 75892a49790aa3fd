"""Schemas of the two core tables, the fact tables and the ledger, as DDL: it can be imported before any session exists."""

from __future__ import annotations

NODE = (
    "urn string, kind string, name string, path string, status string, aliases array<string>, metadata map<string,string>, "
    "retired_at timestamp, created_at timestamp, updated_at timestamp, symbol_kind string, start_line int, end_line int, content_hash string, "
    "enclosing_scope string, is_exported boolean, http_method string, route_path string, "
    "fields array<struct<name:string,type:string,is_id:boolean,is_relation:boolean>>, test_type string, suite_name string, "
    "display_name string, confidence string, confidence_score double, tags array<string>"
)
EDGE = (
    "id string, source_urn string, target_urn string, relationship string, confidence string, confidence_score double, "
    "provenance struct<source:string,timestamp:string,author:string>, evidence struct<type:string,file:string,line:int,symbol:string,reason:string>, "
    "created_at timestamp, updated_at timestamp"
)
IMPORT = "source_file string, module_specifier string, imported_symbols array<string>, is_default boolean, is_namespace boolean, line int"
CALL = "file string, caller_urn string, callee_name string, line int"
USAGE = "id string, session_id string, timestamp timestamp, command string, tokens_requested int, tokens_generated int, query string, details map<string,string>"

KINDS = ("file", "symbol", "route", "model", "test", "feature")
CALLABLE = ("function", "method", "component", "hook", "class")
