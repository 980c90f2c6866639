"""Pieces of SQL for the checks against DuckDB."""

from __future__ import annotations

from arclume.functions.keys import WHITE_SPACE


def key_sql(key: str, kind: str) -> str:
    """The canonical form of the key text ``key`` of the key type ``kind`` (both SQL expressions)."""
    space = " || ".join(f"chr({ord(c)})" for c in WHITE_SPACE)
    text = f"trim({key}, {space})"
    bare = f"regexp_replace(translate(lower({key}), {space} || '{{}}()-\"''', ''), '^urn:uuid:', '')"
    hyphened = f"substr({bare}, 1, 8) || '-' || substr({bare}, 9, 4) || '-' || substr({bare}, 13, 4) || '-' || substr({bare}, 17, 4) || '-' || substr({bare}, 21, 12)"
    digits = f"regexp_replace(regexp_replace({text}, '^\\+', ''), '^(-?)0+([0-9])', '\\1\\2')"
    octets = f"regexp_replace(translate(lower({key}), {space} || ':-_\"''', ''), '^(0x|\\\\x|x)', '')"
    return (
        f"CASE WHEN {kind} = 'uuid' THEN CASE WHEN regexp_full_match({bare}, '[0-9a-f]{{32}}') THEN {hyphened} WHEN regexp_full_match({bare}, '[0-9a-f]+') THEN {bare} ELSE {text} END "
        f"WHEN {kind} IN ('int32', 'int64') THEN CASE WHEN regexp_full_match({text}, '[+-]?[0-9]+') THEN {digits} ELSE {text} END "
        f"WHEN {kind} = 'bytes' THEN CASE WHEN regexp_full_match({octets}, '[0-9a-f]*') THEN {octets} ELSE {text} END "
        f"ELSE nfc_normalize({text}) END"
    )


def edges_sql(where: str = "TRUE") -> str:
    """Edge deltas of the catalog's relations with the canonical keys src and tgt."""
    return (
        f"SELECT e.*, r.src_domain_id AS src_domain, r.tgt_domain_id AS tgt_domain, {key_sql('e.src_key', 's.key_type')} AS src, {key_sql('e.tgt_key', 't.key_type')} AS tgt "
        "FROM edge_deltas e JOIN graph_relations r USING (relation_id) LEFT JOIN graph_domains s ON s.domain_id = r.src_domain_id "
        f"LEFT JOIN graph_domains t ON t.domain_id = r.tgt_domain_id WHERE {where}"
    )


def nodes_sql(table: str) -> str:
    """Node rows with the canonical key ``key``."""
    return f"SELECT n.*, {key_sql('n.node_key', 'd.key_type')} AS key FROM {table} n LEFT JOIN graph_domains d USING (domain_id)"
