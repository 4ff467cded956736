"""Building blocks of the oracle statements (DuckDB dialect), written apart from the Spark expressions."""

from __future__ import annotations

from sitelake import fixed_values as fv


def q(text: str) -> str:
    """A text as SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def trim(x: str) -> str:
    return rf"trim({x}, E' \t\n\r\x0b')"


def fold(path: str) -> str:
    return (
        f"array_to_string(list_reduce(list_transform(string_split({path}, '/'), lambda s: [s]), lambda acc, s: "
        "case when s[1] in ('', '.') then acc when s[1] = '..' then acc[:-2] else list_concat(acc, s) end, []::varchar[]), '/')"
    )


def path_of(url: str) -> str:
    return rf"regexp_extract({url}, '^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


def query_of(url: str) -> str:
    return rf"regexp_extract({url}, '^[^?#]*[?]([^#]*)', 1)"


def host_of(url: str) -> str:
    return rf"lower(regexp_extract({url}, '^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)', 1))"


def or_slash(path: str) -> str:
    return f"coalesce(nullif({path}, ''), '/')"


def folder(path: str) -> str:
    return f"regexp_replace({path}, '[^/]*$', '')"


def decoded(x: str) -> str:
    return f"url_decode({x})"


def resolve(ref: str, page: str, base: str) -> str:
    clean = f"regexp_replace({trim(ref)}, '#.*$', '')"
    joined = f"concat({folder(or_slash(path_of(page)))}, {clean})"
    return (
        f"case when {clean} = '' or regexp_matches({clean}, '(?i)^(mailto|tel|javascript|data|sms|ftp):') then null "
        f"when {clean} like '//%' then 'https:' || {clean} when regexp_matches({clean}, '(?i)^https?://') then {clean} "
        f"when {clean} like '/%' then {base} || {clean} "
        f"else {base} || '/' || {fold(joined)} || case when {clean} like '%/' then '/' else '' end end"
    )


def file_path(url: str) -> str:
    p = f"ltrim({decoded(path_of(url))}, '/')"
    return (
        f"case when {p} like '%..%' then null when rtrim({p}, '/') = '' then 'index.html' "
        f"when {p} like '%/' then rtrim({p}, '/') || '/index.html' "
        f"when regexp_extract({p}, '[^/]*$') like '%.%' then {p} else {p} || '/index.html' end"
    )


def audit_target(ref: str, page_path: str) -> str:
    bare = f"regexp_replace({ref}, '[#?].*$', '')"
    clean = decoded(bare)
    joined = f"replace(case when {clean} like '/%' then {clean} else concat({folder(page_path)}, {clean}) end, chr(92), '/')"
    plain = fold(joined)
    return (
        f"case when {bare} = '' or regexp_matches({bare}, '(?i)^(https?://|mailto:|tel:|data:|javascript:|//)') then null "
        f"when {plain} = '' then 'index.html' when {clean} like '%/' then {plain} || '/' else {plain} end"
    )


DENY = "(/wp-admin|/wp-login[.]php|/wp-json|/xmlrpc[.]php|/wp-cron[.]php|/cart|/checkout|/my-account)"


def crawlable(url: str, site: str) -> str:
    p = or_slash(path_of(url))
    return (
        f"{host_of(url)} = {site} and not regexp_matches({p}, '^{DENY}') and not regexp_matches({p}, '(?i)/(feed|trackback)(/|$)') "
        f"and ({query_of(url)} in ('', '0') or regexp_matches({p}, '(?i)[.][a-z0-9]{{2,5}}$'))"
    )


def entity(x: str) -> str:
    for entity_text, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        x = f"replace({x}, {q(entity_text)}, {q(char)})"
    return x


def unnested(text: str, pattern: str, keys: str, table: str, where: str = "true") -> str:
    """Rows (keys, pos, ref) of all matches of group 1."""
    return (
        f"select {keys}, generate_subscripts(m, 1) - 1 as pos, unnest(m) as ref "
        f"from (select {keys}, regexp_extract_all({text}, {q(pattern)}, 1) as m from {table}) where {where}"
    )


# --- markup ---------------------------------------------------------------------------------------

_REST = r"""(?:[^>"']+|"[^"]*"|'[^']*')*>"""
TAG = rf"(?:</?[a-z!?]{_REST}|</?[a-z!?][^>]*>)"


def _whole(name: str) -> str:
    return rf"<{name}(?:>|[\s/]{_REST}).*?(?:</{name}\s*>|\z)"


COMMENT = r"<!--.*?(?:-->|\z)"
RAW = "|".join([COMMENT, _whole("script"), _whole("style"), _whole("textarea")])
TOKEN = rf"(?is){RAW}|<noscript\b[^>]*>[^<]*</noscript\s*>|{TAG}|[^<]+|<"
SPACE_TOKEN = rf"(?is){RAW}|{_whole('pre')}|{TAG}|[^<]+|<"
_NAME = r"""[^\s=>/"'][^\s=>/]*"""
_VALUE = r"""(?:"[^"]*"|'[^']*'|[^\s>"']+)"""
_BEFORE = rf"(?is)^<[^\s/>]+(?:\s[\s/]*{_NAME}(?:\s*=\s*{_VALUE})?)*?\s[\s/]*"
ATTRIBUTE = rf"(?is)[\s/]*{_NAME}(?:\s*=\s*{_VALUE})?"


def shown(html: str) -> str:
    pattern = rf"(?is){COMMENT}|(<(?:script|style|textarea)(?:>|[\s/]{_REST})).*?(?:</(?:script|style|textarea)\s*>|\z)"
    return rf"regexp_replace({html}, {q(pattern)}, '\1', 'g')"


def all_tags(text: str, name: str | None = None) -> str:
    pattern = rf"(?is){TAG}" if name is None else rf"(?is)<{name}(?:>|[\s/]{_REST}|[\s/][^>]*>)"
    return f"regexp_extract_all({text}, {q(pattern)})"


def attr(tag: str, name: str) -> str:
    pattern = rf"""{_BEFORE}{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
    parts = ", ".join(f"regexp_extract({tag}, {q(pattern)}, {i})" for i in (1, 2, 3))
    return f"concat({parts})"


def has_attr(tag: str, name: str) -> str:
    return f"regexp_matches({tag}, {q(_BEFORE + name + r'(?:[ =/>]|[[:space:]])')})"


def count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {pattern}))"


# --- rewriting: the character before and after a name is captured and put back; two passes cover names side by side.


def _twice(text: str, pattern: str, new: str) -> str:
    once = f"regexp_replace({text}, {pattern}, {new}, 'g')"
    return f"regexp_replace({once}, {pattern}, {new}, 'g')"


def literal(host: str) -> str:
    return rf"replace({host}, '.', '\.')"


AFTER = r"([^a-z0-9\-.]|\z)"
BEFORE = r"(^|[^\w.\-])"
SLASHES = r"(\\?/\\?/)"


def rewrite_host(x: str, source: str, target: str, scheme: str) -> str:
    x = _twice(x, f"'(?i)https?:{SLASHES}' || {literal(source)} || '{AFTER}'", rf"{scheme} || ':\1' || {target} || '\2'")
    x = _twice(x, f"'(?i){SLASHES}' || {literal(source)} || '{AFTER}'", rf"'\1' || {target} || '\2'")
    return _twice(x, f"'(?i){BEFORE}' || {literal(source)} || '{AFTER}'", rf"'\1' || {target} || '\2'")


def rewrite_staging(x: str, label: str = "admin", production: str = "www") -> str:
    return _twice(x, rf"'(?i){BEFORE}{label}\.([a-z0-9\-]+(?:\.[a-z0-9\-]+)+)'", rf"'\1{production}.\2'")


def force_https(x: str, domain: str) -> str:
    return _twice(
        x, rf"'(?i)http:{SLASHES}((?:[a-z0-9\-]+\.)*' || {literal(domain)} || '){AFTER}'", r"'https:\1\2\3'"
    )


def image_ext(x: str) -> str:
    return rf"regexp_replace({x}, {q(fv.ORACLE_IMAGE_END)}, '.webp\2', 'g')"


def chain(x: str, mapped: str, source: str, target: str, scheme: str, domain: str) -> str:
    hosted = f"(case when {mapped} then {rewrite_host(x, source, target, scheme)} else {rewrite_staging(x)} end)"
    return image_ext(force_https(hosted, domain))


def font_display(x: str) -> str:
    """Added everywhere, then taken back where the block had one already."""
    added = rf"regexp_replace({x}, '(?i)(@font-face\s*\{{[^}}]*)\}}', '\1;font-display:swap;}}', 'g')"
    return rf"regexp_replace({added}, '(?i)(@font-face\s*\{{[^}}]*font-display[^}}]*);font-display:swap;\}}', '\1}}', 'g')"


def filled_lines(x: str) -> str:
    return (
        rf"array_to_string(list_filter(regexp_split_to_array({x}, '\r\n|\r|\n'), lambda row: {trim('row')} <> ''), E'\n')"
    )
