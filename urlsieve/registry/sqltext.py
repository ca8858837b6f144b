"""DuckDB building blocks of the reference SQL: named WITH members that later members read."""

from __future__ import annotations

from . import views

SCHEME = "'^[a-zA-Z][a-zA-Z0-9+.-]*://'"
IPV4 = r"'^\d{1,3}(\.\d{1,3}){3}$'"


def lit(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def inlist(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def clean(x: str) -> str:
    return rf"regexp_replace(url_decode(lower(trim({x}))), '[\[\]\x00-\x1f\x7f]', '', 'g')"


def split(x: str, n: int) -> str:
    return f"list_filter(string_split_regex({x}, '[^a-zA-Z0-9]+'), lambda x: length(x) >= {n})"


def parts(x: str) -> str:
    return split(clean(x), 2)


def prefixed(prefix: str, items: str) -> str:
    return f"list_transform({items}, lambda x: '{prefix}:' || x)"


def when_list(cond: str, items: str) -> str:
    return f"(CASE WHEN {cond} THEN {items} ELSE []::VARCHAR[] END)"


def ngrams(p: str) -> str:
    grams = lambda n: (f"list_transform(range(1, length({p}) - {n} + 2), "
                       f"lambda i: 'char:' || substr(lower({p}), i, {n}))")
    return f"({grams(3)} || {grams(4)})"


def parse(target: str) -> str:
    """Select items that split the absolute URL `target`."""
    return f"""lower(split_part({target}, '://', 1)) AS scheme,
       substr({target}, strpos({target}, '://') + 3) AS rest,
       split_part(rest, '#', 1) AS nofrag, split_part(nofrag, '?', 1) AS noq,
       split_part(noq, '/', 1) AS netloc,
       regexp_replace(substr(noq, length(split_part(noq, '/', 1)) + 1), ';[^/]*$', '') AS path,
       substr(nofrag, length(noq) + 2) AS query"""


PAIRS = """list_transform(list_filter(string_split(query, '&'), lambda x: x <> ''), lambda x: {
       'key': url_decode(replace(split_part(x, '=', 1), '+', ' ')),
       'value': url_decode(replace(substr(x, length(split_part(x, '=', 1)) + 2), '+', ' '))})"""

_tokens = " || ".join([
    when_list("strpos(netloc, '@') > 0", "['has_userinfo']"),
    when_list(f"regexp_matches(host, {IPV4})", "['host_is_ip']"),
    when_list("len(labels) > 0", "['tld:' || labels[-1]]"),
    "flatten(list_transform(labels, lambda x, i: [CASE WHEN i = len(labels) THEN 'tldpart:' "
    "WHEN i = len(labels) - 1 THEN 'sld:' ELSE 'subdomain:' END || x, 'domain:' || x] || "
    + "list_transform(" + parts("x").replace("lambda x: length(x)", "lambda z: length(z)")
    + ", lambda y: 'dpart:' || y)))",
    "flatten(list_transform(segs, lambda x: ['path:' || x] || list_transform("
    + parts("x").replace("lambda x: length(x)", "lambda z: length(z)") + ", lambda y: 'pseg:' || y)))",
    when_list("strpos(lastseg, '.') > 0 AND length(split_part(lastseg, '.', -1)) BETWEEN 1 AND 8",
              "['ext:' || split_part(lastseg, '.', -1)]"),
    when_list("query <> ''", "['has_query']"),
    "flatten(list_transform(pairs, lambda p: "
    + when_list("p.key <> ''", "(['qkey:' || p.key] || list_transform("
                + parts("p.key") + ", lambda y: 'qk:' || y))") + " || "
    + when_list("p.value <> ''", "list_transform(" + parts("p.value") + ", lambda y: 'qv:' || y)") + "))",
    prefixed("tok", "tparts"),
    "flatten(list_transform(list_filter(tparts, lambda x: length(x) >= 6), lambda p: " + ngrams("p") + "))",
    when_list("strpos(dec, '-') > 0", "['has_hyphen']"),
    when_list("strpos(dec, '_') > 0", "['has_underscore']"),
    when_list("strpos(dec, '%') > 0", "['has_percent_encoding']"),
    when_list("length(dec) - length(replace(dec, '.', '')) >= 4", "['many_dots']"),
    when_list("length(dec) >= 100", "['very_long_url']"),
])

BLOCKS: dict[str, str] = {
    "urls": views.URLS.format(pages="pages"),
    "html_pages": views.HTML_PAGES.format(pages="pages"),
    "crawl": views.CRAWL.format(pages="pages"),
    "probs": views.PROBABILITIES.format(urls="urls"),
    "url_c": f"SELECT *, {clean('url')} AS dec, {clean('dec')} AS c2 FROM urls",
    # tokeniser-side parts
    "url_p": f"""SELECT row_id, url, type, dec, c2,
       CASE WHEN regexp_matches(c2, {SCHEME}) THEN c2 ELSE 'http://' || c2 END AS target, {parse('target')},
       lower(netloc) AS lnetloc FROM url_c""",
    "url_tok": f"""SELECT row_id, url, type, dec,
       CASE WHEN len(toks) = 0 THEN ['empty_or_invalid_url'] ELSE toks END AS tokens
FROM (SELECT *, {_tokens} AS toks
      FROM (SELECT row_id, url, type, dec, netloc, lower(query) AS query,
                   regexp_replace(split_part(split_part(lnetloc, '@', -1), ':', 1), '^www[.]', '') AS host,
                   list_filter(string_split(host, '.'), lambda x: x <> '') AS labels,
                   list_filter(string_split(lower(path), '/'), lambda x: x <> '') AS segs,
                   coalesce(segs[-1], '') AS lastseg,
                   {PAIRS.replace('string_split(query', 'string_split(lower(query)')} AS pairs,
                   {split('c2', 2)} AS tparts
            FROM url_p))""",
    "tok": "SELECT row_id, type, unnest(list_distinct(tokens)) AS token FROM url_tok",
    "tok_ids": "SELECT row_id, token FROM tok",
    # evidence-side parts
    "ev_p": f"""SELECT *, coalesce(labels[-1], '') AS tld, coalesce(labels[-2], '') AS sld,
       CASE WHEN len(labels) >= 3 THEN labels[1:len(labels) - 2] ELSE []::VARCHAR[] END AS sub_labels,
       lower(split_part(path, '/', -1)) AS last_segment,
       CASE WHEN strpos(last_segment, '.') > 0 THEN split_part(last_segment, '.', -1) END AS extension,
       flatten(list_transform(labels, lambda y: {split('y', 1)})) AS label_parts,
       flatten(list_transform(sub_labels, lambda y: {split('y', 1)})) AS sub_parts,
       {split('path', 1)} AS path_parts, {split('query', 1)} AS query_parts,
       list_distinct(sub_labels || sub_parts || path_parts || query_parts) AS context_parts,
       {PAIRS} AS pairs
FROM (SELECT row_id, url, type, url_decode(lower(trim(url))) AS dec0,
             CASE WHEN regexp_matches(dec0, {SCHEME}) THEN dec0 ELSE 'https://' || dec0 END AS clean,
             {parse('clean')},
             split_part(split_part(netloc, '@', -1), ':', 1) AS host,
             list_filter(string_split(host, '.'), lambda x: x <> '') AS labels,
             regexp_matches(host, {IPV4}) AS is_ipv4
      FROM urls)""",
}

NEEDS: dict[str, list[str]] = {
    "probs": ["urls"], "url_c": ["urls"], "url_p": ["url_c"], "url_tok": ["url_p"], "tok": ["url_tok"], "tok_ids": ["tok"],
    "ev_p": ["urls"],
}


def add(name: str, sql: str, *needs: str) -> None:
    BLOCKS[name] = sql
    NEEDS[name] = list(needs)


def query(sql: str, *needs: str) -> str:
    """One statement: the needed blocks, in order, then `sql`."""
    order: list[str] = []

    def visit(name: str) -> None:
        for n in NEEDS.get(name, []):
            visit(n)
        if name not in order:
            order.append(name)

    for n in needs:
        visit(n)
    if not order:
        return sql
    members = ",\n".join(f"{n} AS MATERIALIZED ({BLOCKS[n]})" for n in order)
    return f"WITH {members}\n{sql}"
