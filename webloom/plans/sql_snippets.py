"""DuckDB SQL fragments used by the oracle statements (text templates only)."""
from __future__ import annotations

NETLOC = "regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
SCHEME_AUTH = "regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
WS = (r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
RAW_BLOCKS = r"(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"


def netloc(u: str) -> str:
    return NETLOC.format(u=u)


def scheme_auth(u: str) -> str:
    return SCHEME_AUTH.format(u=u)


def py_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def decode(x: str) -> str:
    for pat, ch in [("&quot;?", '"'), ("&#39;", "''"), ("&lt;?", "<"), ("&gt;?", ">"),
                    ("&nbsp;?", "\u00a0"), ("&copy;?", "\u00a9"), ("&middot;?", "\u00b7"),
                    ("&amp;?", "&")]:
        x = f"regexp_replace({x}, '{pat}', '{ch}', 'g')"
    return x


def nodes(h: str, tag: str) -> str:
    return (f"list_transform(regexp_extract_all({h}, '<{tag}(?:\\s[^>]*)?>([^<]*)', 1), "
            f"lambda z: {decode('z')})")


def nonempty(lst: str) -> str:
    return f"list_filter({lst}, lambda z: length(z) > 0)"


def all_nodes(h: str) -> str:
    out = nonempty(nodes(h, "title"))
    for tag in ["p"] + [f"h{i}" for i in range(1, 7)]:
        out = f"list_concat({out}, {nonempty(nodes(h, tag))})"
    return out


def hostname(u: str) -> str:
    h = (f"lower(regexp_replace(regexp_extract({netloc(u)}, '^(?:.*@)?(\\[[^\\]]*\\]|[^:]*)', 1), "
         f"'^\\[|\\]$', '', 'g'))")
    return f"nullif({h}, '')"


def root_domain(h: str) -> str:
    return (f"CASE WHEN len(string_split({h}, '.')) > 2 "
            f"THEN array_to_string(string_split({h}, '.')[-2:], '.') ELSE {h} END")


def json_len(s: str) -> str:
    def cnt(p):
        return f"len(regexp_extract_all({s}, '{p}'))"
    return (f"(length({s}) + {cnt(r'[\\\"\n\r\t\x08\x0c]')} + 5 * ({cnt(r'[^\x20-\x7e]')} - "
            f"{cnt(r'[\n\r\t\x08\x0c]')}) + 6 * {cnt(r'[\x{10000}-\x{10FFFF}]')})")


# pages with raw blocks removed: (page_id, url, h)
CLEAN_PAGES = f"SELECT page_id, url, regexp_replace(html, '{RAW_BLOCKS}', '', 'g') AS h FROM pages"

# page text, native form: (page_id, url, host, content, n_chars)
PAGE_TEXT = f"""
SELECT page_id, url, {netloc('url')} AS host, content, CAST(length(content) AS BIGINT) AS n_chars
FROM (SELECT page_id, url,
             array_to_string(list_filter(list_transform({all_nodes('h')}, lambda y: {py_strip('y')}),
                                         lambda y: y <> ''), ' ') AS content
      FROM ({CLEAN_PAGES}))
WHERE length(content) > 0
"""

# one row per href: (page_id, url, href, link)
PAGE_LINKS = f"""
SELECT page_id, url, href, {scheme_auth('url')} || href AS link
FROM (SELECT page_id, url, {decode('raw')} AS href
      FROM (SELECT page_id, url, unnest(regexp_extract_all(h, '<a\\s[^>]*href="([^"]*)"', 1)) AS raw
            FROM ({CLEAN_PAGES})))
"""
