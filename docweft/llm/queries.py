"""All queries of this subpackage and their SQL, as ``__spark_entry__`` registers them."""

from docweft.llm import queries_audit, queries_chat, queries_join, queries_lines, queries_merkle, queries_native, queries_packing, queries_text

MODULES = (queries_text, queries_native, queries_join, queries_lines, queries_packing, queries_audit, queries_merkle, queries_chat)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in (queries_text, queries_native, queries_lines, queries_audit, queries_merkle, queries_chat) for name, sql in m.SQL.items()}
