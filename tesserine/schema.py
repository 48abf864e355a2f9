"""Schemas of the engine's tables, as DDL. Fields that are absent are empty, not null."""

from __future__ import annotations

PARAM = "struct<name:string,type_hint:string,default:string,is_optional:boolean>"
FUNCTION = f"struct<name:string,parameters:array<{PARAM}>,return_type:string,docstring:string,line:int,is_async:boolean,is_private:boolean,is_property:boolean,decorators:array<string>,heads_count:int>"
CONSTANT = "struct<name:string,type_hint:string,value:string>"
CLASS = f"struct<name:string,docstring:string,bases:array<string>,methods:array<{FUNCTION}>,class_vars:array<{CONSTANT}>,line:int>"
ROUTE = "struct<method:string,path:string,handler:string,line:int,docstring:string>"
MODULE_FIELDS = f"path string, name string, language string, docstring string, functions array<{FUNCTION}>, classes array<{CLASS}>, constants array<{CONSTANT}>, routes array<{ROUTE}>, imports array<string>, env_vars map<string,array<string>>"
SOURCE_FILES = "path string, path_parts array<string>, ext string, language string, content string, content_hash string, n_chars bigint"
MODULES = f"module_ord bigint, {MODULE_FIELDS}"
MODULE_STRUCT = "struct<" + ",".join(x.strip().replace(" ", ":", 1) for x in f"module_ord bigint|path string|name string|language string|docstring string|functions array<{FUNCTION}>|classes array<{CLASS}>|constants array<{CONSTANT}>|routes array<{ROUTE}>|imports array<string>|env_vars map<string,array<string>>".split("|")) + ">"
MODULE_CACHE = f"path string, content_hash string, parse_opts string, module {MODULE_STRUCT}"
VIOLATIONS = "doc string, line_no int, rule string, message string"
