"""The same answers as DuckDB SQL, written apart from the plans."""

from __future__ import annotations

import re

from ravelin.functions.payloads import ESCAPES, FROM_HEX, HEX_BLOCK, HEX_ESCAPES, PERCENT
from ravelin.functions.stages import ANSWER, QUESTION, STAGE_PATTERNS, STAGES, WINDOW
from ravelin.operators import signals
from ravelin.plans.corpus import LINES_SQL, PLANTED_SQL, PYTHON
from ravelin.plans.queries import _AROUND, _HOSTILE, CATEGORIES, CONFIG
from ravelin.sources.config import BINARY
from ravelin.sources.rules import Rule, builtin_rules

_RE2 = (
    (r"(?![\w.])", r"(?:$|[^\w.])"),
    (r"\bos\.environ\b(?!\.get\b)(?!\[)", r"\bos\.environ(?:$|[^\w.\[]|\.(?:$|[^gG]|[gG](?:$|[^eE]|[eE](?:$|[^tT]|[tT]\w))))"),
    (r"process\.env\b(?!\.)(?!\[)", r"process\.env(?:$|[^\w.\[])"),
    (r"\u202a-\u202e", r"\x{202a}-\x{202e}"),
    (r"\u200b\u200c\u200d\u2060\ufeff", r"\x{200b}\x{200c}\x{200d}\x{2060}\x{feff}"),
)


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    for a, b in _RE2:
        pattern = pattern.replace(a, b)
    return q(pattern)


def matched(pattern: str, text: str) -> str:
    """What a pattern matches. What stands for looking ahead consumes a sign, so that the rest is a group."""
    for ahead, consumed in _RE2[:3]:
        if ahead in pattern:
            flags = re.match(r"(\(\?[a-z]+\))?", pattern)[0]
            head, tail = pattern[len(flags) :].split(ahead)
            if ahead.startswith("(?"):
                inner = f"{flags}({head}){consumed}"
            else:
                name = ahead.split("(?!")[0].removesuffix(r"\b")
                inner = f"{flags}{head}({name}){consumed.removeprefix(name)}"
            assert not tail
            return f"regexp_extract({text}, {q(inner)}, 1)"
    return f"regexp_extract({text}, {re2(pattern)})"


def hits(rules: list[Rule], carry: str = "doc_id", line: str = "line") -> str:
    """A SELECT for each pattern, over the relation ``lines``; a strict rule's exclusions hold within what matched."""
    parts = []
    for r in rules:
        no = "".join(f" AND NOT regexp_matches({line}, {re2(x)})" for x in r.excludes if r.mode == "default")
        no += "".join(f" AND NOT regexp_matches(relative_path, {re2(x)})" for x in r.path_excludes)
        for i, p in enumerate(r.patterns):
            text = f"left({matched(p, line)}, 200)"
            within = "".join(f" AND NOT regexp_matches(regexp_extract({line}, {re2(p)}), {re2(x)})" for x in r.excludes if r.mode == "strict")
            parts.append(f"SELECT {q(r.rule_id)} AS rule_id, {i} AS ord, {carry}, line_no, CAST({text} AS VARCHAR) AS matched_text, {q(r.severity)} AS severity, {q(r.category)} AS category FROM lines WHERE regexp_matches({line}, {re2(p)}){no}{within}")
    return "\nUNION ALL ".join(parts)


_LINE_RULES = [r for r in builtin_rules() if r.scope == "line"]
_MARKED = f"WITH {LINES_SQL}, marked AS MATERIALIZED ({hits(_LINE_RULES, 'package_id, relative_path')})"
def _category(category: str) -> str:
    rules = [r for r in _LINE_RULES if r.category == category and r.mode == "default"]
    return f"WITH {LINES_SQL} SELECT rule_id, ord, doc_id, line_no, matched_text FROM ({hits(rules)})"


_RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
_DRIVER = "CASE category WHEN 'prompt-injection' THEN 'operator-manipulation' WHEN 'agent-manipulation' THEN 'operator-manipulation' WHEN 'malicious-code' THEN 'execution' WHEN 'tool-abuse' THEN 'execution' WHEN 'data-exfiltration' THEN 'exfiltration' WHEN 'credential-exposure' THEN 'credential-access' WHEN 'supply-chain' THEN 'remote-bootstrap' WHEN 'obfuscation' THEN 'stealth/obfuscation' END"


def _role(path: str) -> str:
    low = f"lower({path})"
    parts = f"string_split({low}, '/')"
    marks = "['example', 'examples', 'fixture', 'fixtures', 'reference', 'references', 'sample', 'samples']"
    return f"""CASE WHEN {low} = 'skill.md' THEN 'entrypoint'
      WHEN list_contains({marks}, regexp_replace({parts}[-1], '\\.[^.]*$', '')) OR len(list_intersect({parts}[:-2], {marks})) > 0 THEN 'reference'
      WHEN regexp_matches({low}, '\\.(bash|js|ps1|py|sh|ts|zsh)$') THEN 'script' WHEN regexp_matches({low}, '\\.(cfg|env|ini|jinja2|json|toml|ya?ml)$') THEN 'config' ELSE 'support-doc' END"""


_INVISIBLE = r"[\x{200b}\x{200c}\x{200d}\x{2060}\x{feff}\x{ad}]"
_SPACES = r"[\x{a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"
_PLAIN = f"regexp_replace(regexp_replace(regexp_replace(line, '{_INVISIBLE}', '', 'g'), '{_SPACES}', ' ', 'g'), ' {{2,}}', ' ', 'g')"


def _normalized() -> str:
    rules = _LINE_RULES
    return f"""WITH {LINES_SQL}, plain AS MATERIALIZED (SELECT * EXCLUDE (line), line AS before, {_PLAIN} AS line FROM lines),
first_ AS (SELECT DISTINCT doc_id, line_no, rule_id FROM ({hits(rules)})),
again AS ({hits(rules).replace('FROM lines', 'FROM plain').replace(' WHERE ', ' WHERE before <> line AND ')})
SELECT rule_id, ord, doc_id, line_no, matched_text FROM again ANTI JOIN first_ USING (doc_id, line_no, rule_id)"""


def _b64() -> str:
    """Python's pattern has borders that RE2 lacks: runs of the alphabet are found whole, then judged."""
    run = "regexp_extract_all(line, '[0-9A-Za-z+/]+=*')"
    return f"""SELECT doc_id, line_no, 'base64' AS kind, regexp_extract(x, '^([0-9A-Za-z+/]+={{0,3}})', 1) AS encoded
      FROM (SELECT doc_id, line_no, unnest({run}) AS x FROM lines) WHERE regexp_matches(x, '^[0-9A-Za-z+/]{{17,}}') AND length(regexp_extract(x, '^([0-9A-Za-z+/]+={{0,3}})', 1)) >= 20"""


_ALL = "regexp_extract_all(line, {}, {})"
_HEX = f"""SELECT doc_id, line_no, 'hex' AS kind, unnest({_ALL.format(q(FROM_HEX), 1)}) AS encoded FROM lines
      UNION ALL SELECT doc_id, line_no, 'hex', replace(unnest({_ALL.format(q(HEX_ESCAPES), 1)}), chr(92) || 'x', '') FROM lines
      UNION ALL SELECT doc_id, line_no, 'hex', unnest({_ALL.format(q(HEX_BLOCK.replace('(?<![0-9A-Za-z])', chr(92) + 'b').replace('(?![0-9A-Za-z])', chr(92) + 'b')), 1)}) FROM lines"""
_EXTRACT = f"""WITH {LINES_SQL}, found AS ({_b64()}
      UNION ALL {_HEX}
      UNION ALL SELECT doc_id, line_no, 'url', unnest({_ALL.format(q(PERCENT), 1)}) FROM lines
      UNION ALL SELECT doc_id, line_no, 'unicode_escape', unnest({_ALL.format(q(ESCAPES), 1)}) FROM lines)"""
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_FENCED = rf"""WITH {LINES_SQL}, b AS (SELECT doc_id, line_no, regexp_replace(line, '^\s+', '') AS bare FROM lines),
f AS (SELECT *, starts_with(bare, '```') AS fence FROM b),
g AS (SELECT *, sum(CAST(fence AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no) % 2 = 1 AND NOT fence AS in_fence FROM f)
SELECT doc_id, line_no, in_fence FROM g WHERE in_fence OR (NOT fence AND (starts_with(bare, '#') OR starts_with(bare, '//')))"""
_MASK = " + ".join(f"CASE WHEN regexp_matches(line, {q('(?i)(?:' + '|'.join(STAGE_PATTERNS[s]) + ')')}) THEN {1 << k} ELSE 0 END" for k, s in enumerate(STAGES))
_WINDOWS = f"""WITH RECURSIVE {LINES_SQL}, m AS (SELECT doc_id, line_no, {_MASK} AS m FROM lines),
w AS (SELECT doc_id, line_no, bit_or(m) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS mask FROM m),
c AS (SELECT * FROM w WHERE bit_count(mask) >= 2)"""
_KEEP = f"list_filter(kept, lambda o: NOT ((o.m & n.mask) = o.m AND o.m <> n.mask AND n.line_no - o.l < {WINDOW}))"
_ATTACKS = f"""{_WINDOWS},
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM c),
walk AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(l INT, m INT)[]) AS kept FROM (SELECT DISTINCT doc_id FROM n)
  UNION ALL
  SELECT w.doc_id, n.k, CASE WHEN len(list_filter({_KEEP}, lambda p: (p.m & n.mask) = n.mask AND n.line_no - p.l < {WINDOW})) > 0 THEN {_KEEP} ELSE list_append({_KEEP}, {{'l': n.line_no, 'm': n.mask}}) END
  FROM walk w JOIN n ON n.doc_id = w.doc_id AND n.k = w.k + 1),
last_ AS (SELECT doc_id, arg_max(kept, k) AS kept FROM walk GROUP BY doc_id)
SELECT doc_id, x.l AS line_no, array_to_string(list_filter(['exfil', 'read', 'transform'], lambda s, i: (x.m >> (i - 1)) & 1 = 1), ' + ') AS stages FROM (SELECT doc_id, unnest(kept) AS x FROM last_)"""


def _exchanges(said: str, key: str, at: str) -> str:
    return f"""s AS ({said}), b AS (SELECT *, lag(kind) OVER (PARTITION BY {key} ORDER BY place) AS before FROM s WHERE kind IS NOT NULL),
p AS (SELECT {key}, CAST(count(*) FILTER (WHERE kind = 'A' AND before = 'Q') AS BIGINT) AS pairs, min(place) FILTER (WHERE kind = 'Q') AS {at} FROM b GROUP BY {key})"""


_NOQA_STRINGS = r""""(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'"""
_SAFETY = f"""WITH p AS (SELECT *, octet_length(encode(content)) AS size, lower(regexp_extract(relative_path, '[^/](\\.[^./]+)$', 1)) AS suffix FROM ({PLANTED_SQL})),
r AS (SELECT package_id, relative_path AS file, CASE WHEN suffix IN {BINARY} THEN 'FS-002' WHEN suffix <> '' AND suffix NOT IN {tuple(sorted(CONFIG.extensions))} THEN 'FS-003' WHEN size > {CONFIG.max_file_size} THEN 'FS-005' END AS rule_id FROM p),
t AS (SELECT package_id, sum(size) AS bytes, count(*) AS n FROM p GROUP BY package_id)
SELECT package_id, file, rule_id, CASE rule_id WHEN 'FS-002' THEN 'high' ELSE 'medium' END AS severity FROM (
  SELECT * FROM r WHERE rule_id IS NOT NULL
  UNION ALL SELECT package_id, '<package>', 'FS-006' FROM t WHERE bytes > {CONFIG.max_total_size}
  UNION ALL SELECT package_id, '<package>', 'FS-007' FROM t WHERE n > {CONFIG.max_file_count})"""
_FRONT = f"""WITH p AS (SELECT package_id, content FROM ({PLANTED_SQL}) WHERE relative_path = 'SKILL.md'),
a AS (SELECT DISTINCT package_id FROM ({PLANTED_SQL})),
b AS (SELECT package_id, regexp_extract(content, '^---\n((?s:.*?))\n---\n', 1) AS inner_, starts_with(content, '---' || chr(10)) AS opens FROM p),
c AS (SELECT package_id, opens, regexp_extract(inner_, '(?m)^name: *(.*)$', 1) AS name, trim(regexp_extract(inner_, '(?m)^description: *(.*)$', 1), '"') AS said FROM b)
SELECT a.package_id, CASE WHEN e.error IS NULL THEN e.name ELSE a.package_id END AS name, coalesce(e.error, CASE WHEN e.package_id IS NULL THEN 'missing file' END) AS error
FROM a LEFT JOIN (SELECT *, CASE WHEN NOT opens THEN 'no front matter' WHEN name = '' THEN 'missing name' WHEN said = '' THEN 'missing description' WHEN NOT regexp_matches(name, '^[a-z0-9]([a-z0-9-]*[a-z0-9])?$') THEN 'invalid name' END AS error FROM c) e USING (package_id)"""


def _says(text: str, what: str) -> str:
    return f"regexp_matches({text}, {q(signals.WORDING[what])})"


def _judged_urls(table: str) -> str:
    """CTEs that add driver, severity and runs to a table of (url, around)."""
    return f"""parts_ AS (SELECT *, lower(regexp_replace(regexp_extract(url, '^https?://([^/?#]*)', 1), '^.*@', '')) AS place, lower(regexp_extract(url, '^https?://[^/?#]*([^?#;]*)', 1)) AS path, string_split(regexp_extract(url, '\\?([^#]*)', 1), '&') AS pairs FROM {table}),
hosts AS (SELECT *, regexp_replace(place, ':\\d*$', '') AS host FROM parts_),
facts AS (SELECT *, host <> '' AND (len(list_filter({list(signals.HOSTS)}, lambda m: contains(host, m))) > 0 OR host IN {signals.SHORTENERS}
    OR (regexp_matches(host, '^\\d+(\\.\\d+){{3}}$') AND list_max(list_transform(string_split(host, '.'), lambda d: coalesce(TRY_CAST(d AS INT), 999))) <= 255)) AS bad,
  len(list_filter({list(signals.HOOKS)}, lambda m: contains(host, m))) > 0 OR {_says("path", "hook")} OR {_says("around", "hook")} AS hook,
  len(list_filter({list(signals.FILES)}, lambda e: ends_with(path, e))) > 0 AS file_,
  {_says("around", "execution")} OR {_says("around", "remote")} AS runs,
  len(list_filter(pairs, lambda p: contains(p, '=') AND substr(p, strpos(p, '=') + 1) <> '' AND (regexp_matches(coalesce(TRY(url_decode(replace(split_part(p, '=', 1), '+', ' '))), split_part(p, '=', 1)), {q(signals.WORDING["key"])}) OR regexp_matches(coalesce(TRY(url_decode(replace(substr(p, strpos(p, '=') + 1), '+', ' '))), substr(p, strpos(p, '=') + 1)), {q(signals.WORDING["value"])})))) > 0 AS risky FROM hosts),
judged AS (SELECT *, CASE WHEN bad AND hook THEN 'exfiltration' WHEN bad OR file_ OR risky OR runs THEN 'remote-bootstrap' END AS driver, CASE WHEN bad THEN 'high' ELSE 'medium' END AS severity FROM facts)"""


_HINTED = " OR ".join(f"contains(lower(s), {q(h)})" for h in signals.HINTS)
_SNIPPETS = r"""list_concat(list_concat(regexp_extract_all(content, '(?s)```[^\n`]*\n(.*?)```', 1), regexp_extract_all(content, '`([^`\n]{4,200})`', 1)),
  regexp_extract_all(content, '(?im)^\s*(?:\$|PS>|cmd>)?\s*(?:curl|wget|bash|sh|python|pwsh|powershell)\b[^\n]+$', 0))"""
_COMMAND = f"len(list_filter(list_transform({_SNIPPETS}, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda s: {_HINTED})) > 0"
_SIGNALS = f"""texts AS (SELECT package_id, relative_path AS file, content, {_role('relative_path')} AS role, {_COMMAND} AS command FROM ({PLANTED_SQL})),
asked AS (SELECT * FROM texts WHERE NOT (role = 'reference' AND {_says("content", "warning")})),
sig AS (
  SELECT package_id, file, role, 'PKG-001' AS rule_id, CASE WHEN {_says("content", "coercion")} THEN 'high' ELSE 'medium' END AS severity, 'operator-manipulation' AS driver FROM asked
  WHERE command AND ({_says("content", "coercion")} OR (role IN ('entrypoint', 'support-doc') AND contains(lower(content), 'run')))
  UNION ALL SELECT package_id, file, role, 'PKG-003', 'high', 'credential-access' FROM asked WHERE {_says("content", "secret")}
  UNION ALL SELECT package_id, file, role, 'PKG-002', CASE WHEN NOT {_says("content", "remote")} AND {_says("content", "piped")} THEN 'critical' ELSE 'high' END, 'remote-bootstrap' FROM asked
  WHERE {_says("content", "remote")} OR (command AND {_says("content", "bootstrap")}))"""
_URL_RE = "https?://[^\\s<>()\"''`]+"
_URL_SIGNALS = f"""found_urls AS (SELECT package_id, file, role, content, role = 'reference' AND {_says("content", "warning")} AS quiet, regexp_extract_all(content, '{_URL_RE}') AS ms, regexp_split_to_array(content, '{_URL_RE}') AS gaps FROM texts WHERE contains(content, '://')),
each_url AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM found_urls),
placed AS (SELECT *, length(array_to_string(gaps[1 : i], '')) + length(array_to_string(ms[1 : i - 1], '')) AS st, length(ms[i]) AS n FROM each_url),
cut AS (SELECT package_id, file, role, i, quiet, {_says("content", "setup")} AS setup, rtrim(ms[i], '.,;)') AS url, substr(content, greatest(0, st - 80) + 1, st + n + 80 - greatest(0, st - 80)) AS around FROM placed),
{_judged_urls("cut")},
urls_bad AS (SELECT *, row_number() OVER (PARTITION BY package_id, file, driver ORDER BY i) AS nth FROM judged WHERE driver IS NOT NULL),
sig_urls AS (
  SELECT package_id, file, role, 'PKG-004' AS rule_id, severity, driver, 1 AS suspicious_urls FROM urls_bad WHERE nth = 1
  UNION ALL SELECT DISTINCT package_id, file, role, 'PKG-005', 'medium', 'operator-manipulation', 0 FROM judged WHERE NOT quiet AND setup AND runs)"""
_TEXT_SIGNALS = f"{_SIGNALS}, {_URL_SIGNALS}, sig_all AS (SELECT *, 0 AS suspicious_urls FROM sig UNION ALL SELECT * FROM sig_urls)"
_DRIVERS = ("credential-access", "execution", "exfiltration", "operator-manipulation", "remote-bootstrap", "stealth/obfuscation")
_RISK = f"""{_MARKED}, {_TEXT_SIGNALS},
a AS (SELECT package_id, 'f' AS src, {_role('relative_path')} AS role, {_DRIVER} AS driver, severity FROM marked UNION ALL SELECT package_id, 's', role, driver, severity FROM sig_all),
u AS (SELECT package_id, CAST(sum(suspicious_urls) AS INT) AS urls FROM sig_all GROUP BY package_id),
b AS (SELECT *, {_RANK} AS rank, CASE severity WHEN 'critical' THEN 10 WHEN 'high' THEN 7 WHEN 'medium' THEN 4 WHEN 'low' THEN 2 ELSE 0.5 END
    * CASE role WHEN 'entrypoint' THEN 1.4 WHEN 'script' THEN 1.35 WHEN 'config' THEN 1.1 WHEN 'support-doc' THEN 0.8 ELSE 0.35 END
    * CASE WHEN role = 'reference' AND driver IN ('operator-manipulation', 'remote-bootstrap') THEN 0.6 ELSE 1.0 END AS pts,
  role IN ('entrypoint', 'script') AND driver IN ('execution', 'exfiltration', 'operator-manipulation', 'remote-bootstrap') AND severity IN ('high', 'critical') AS danger FROM a),
g AS (SELECT package_id, sum(pts) AS base, count(DISTINCT role) FILTER (WHERE rank >= 2) >= 2 AS wide, bool_or(danger) AS direct, bool_or(danger AND rank = 4) AS severe,
  bool_or(src = 's' AND driver IN ('operator-manipulation', 'remote-bootstrap') AND role IN ('entrypoint', 'support-doc')) AND bool_or(src = 'f' AND driver IN ('execution', 'exfiltration') AND role = 'script') AS c1,
  bool_or(src = 's' AND driver = 'remote-bootstrap' AND role = 'config') AND bool_or(src = 'f' AND driver IN ('execution', 'exfiltration') AND role = 'script') AS c2,
  bool_or(src = 's' AND driver = 'credential-access') AND bool_or(src = 'f' AND driver = 'exfiltration') AS c3 FROM b GROUP BY package_id),
n AS (SELECT p.package_id, coalesce(base, 0) AS base, coalesce(wide, false) AS wide, coalesce(direct, false) AS direct, coalesce(severe, false) AS severe, CAST(coalesce(c1, false) AS INT) AS c1, CAST(coalesce(c2, false) AS INT) AS c2, CAST(coalesce(c3, false) AS INT) AS c3
  FROM (SELECT DISTINCT package_id FROM planted) p LEFT JOIN g USING (package_id)),
s AS (SELECT *, base + 6 * (c1 + c2 + c3) + CASE WHEN wide THEN 6 ELSE 0 END AS score FROM n),
d AS (SELECT s.package_id, x.driver, coalesce((SELECT sum(pts) FROM b WHERE b.package_id = s.package_id AND b.driver = x.driver), 0)
    + CASE x.driver WHEN 'credential-access' THEN c3 * 6 WHEN 'execution' THEN c1 * 6 + c2 * 4 WHEN 'exfiltration' THEN c3 * 6 WHEN 'operator-manipulation' THEN c1 * 6 + CASE WHEN wide THEN 3 ELSE 0 END
      WHEN 'remote-bootstrap' THEN c2 * 6 + CASE WHEN wide THEN 3 ELSE 0 END ELSE 0 END AS pts FROM s, (SELECT unnest({list(_DRIVERS)}) AS driver) x),
t AS (SELECT package_id, string_agg(driver, ',' ORDER BY pts DESC, driver) AS top_drivers FROM (SELECT * FROM d WHERE pts > 0 QUALIFY row_number() OVER (PARTITION BY package_id ORDER BY pts DESC, driver) <= 3) GROUP BY package_id)
SELECT s.package_id, CAST(round_even(score, 0) AS INTEGER) AS score, CASE WHEN severe OR score >= 40 THEN 'severe' WHEN direct OR score >= 20 THEN 'high' WHEN score >= 8 THEN 'guarded' ELSE 'low' END AS band,
  coalesce(top_drivers, '') AS top_drivers, coalesce(urls, 0) AS suspicious_url_count, c1 + c2 + c3 AS correlated_signal_count FROM s LEFT JOIN t USING (package_id) LEFT JOIN u USING (package_id)"""
_COMMANDS = f"""SELECT doc_id, s AS snippet, {_HINTED} AS command FROM (SELECT doc_id, unnest(list_concat(
    list_filter(list_transform(regexp_extract_all(content, '(?s)```[^\\n`]*\\n(.*?)```', 1), lambda x: {_STRIP.format('x')}), lambda x: x <> ''),
    list_concat(list_transform(regexp_extract_all(content, '`([^`\\n]{{4,200}})`', 1), lambda x: {_STRIP.format('x')}),
    list_transform(regexp_extract_all(content, '(?im)^\\s*(?:\\$|PS>|cmd>)?\\s*(?:curl|wget|bash|sh|python|pwsh|powershell)\\b[^\\n]+$', 0), lambda x: {_STRIP.format('x')})))) AS s FROM ({PLANTED_SQL}))"""
_URLS = f"""WITH u AS (SELECT page_id, {_HOSTILE} AS url, {_AROUND} AS around FROM pages), {_judged_urls("u")}
SELECT page_id, driver, severity FROM judged WHERE driver IS NOT NULL"""
_REMOTE = """WITH s AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'own/repo' || page_id WHEN 1 THEN 'own/repo@v1.' || page_id WHEN 2 THEN 'own' WHEN 3 THEN 'a/b/c' ELSE 'o_w/n@' END AS source FROM pages),
v AS (SELECT *, page_id % 5 IN (0, 1) AS ok FROM s)
SELECT page_id, CASE WHEN ok THEN split_part(source, '/', 1) END AS owner, CASE WHEN ok THEN split_part(split_part(source, '/', 2), '@', 1) END AS repo,
  CASE WHEN page_id % 5 = 1 THEN split_part(source, '@', 2) END AS ref, CASE WHEN NOT ok THEN 'invalid source' END AS error FROM v"""
_CUSTOM = """WITH s AS (SELECT page_id, string_split(replace(replace(html, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS parts FROM pages),
l AS (SELECT page_id, CAST(generate_subscripts(parts, 1) AS INTEGER) AS line_no, unnest(parts) AS line FROM s)
SELECT page_id, line_no, 'OWN-1' AS rule_id, regexp_extract(line, '(?i)<script[^>]{0,40}>') AS matched_text FROM l WHERE regexp_matches(line, '(?i)<script[^>]{0,40}>') AND NOT regexp_matches(line, '(?i)<noscript')"""
_FILE = r"""WITH p AS (SELECT doc_id, relative_path, content FROM (""" + PLANTED_SQL + r""")),
x AS (SELECT doc_id, 0 AS ord, content, '(?is)exec\s*\(\s*(?:compile\s*\(\s*)?base64\.b64decode\s*\(' AS re FROM p UNION ALL SELECT doc_id, 1, content, '(?is)eval\s*\(\s*(?:compile\s*\(\s*)?base64\.b64decode\s*\(' FROM p),
m AS (SELECT doc_id, ord, regexp_extract_all(content, re) AS found, content FROM x WHERE regexp_matches(content, re))
SELECT doc_id, 'EXEC-009' AS rule_id, ord, CAST(len(string_split(left(content, strpos(content, found[1]) - 1), chr(10))) AS INTEGER) AS line_no, left(found[1], 200) AS matched_text FROM m
WHERE NOT regexp_matches(string_split(content, chr(10))[len(string_split(left(content, strpos(content, found[1]) - 1), chr(10)))], '(?i)test.*fixture|example.*base64|anti-pattern')"""
_STRICT = f"WITH {LINES_SQL} SELECT rule_id, ord, doc_id, line_no, matched_text FROM ({hits([r for r in _LINE_RULES if r.mode == 'strict'])})"
_LEVEL = "CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END"
_WEIGHT = f"CASE {_role('relative_path')} WHEN 'entrypoint' THEN 1.4 WHEN 'script' THEN 1.35 WHEN 'config' THEN 1.1 WHEN 'support-doc' THEN 0.8 ELSE 0.35 END"

ORACLE_SQL: dict[str, str] = {f"match_{c.replace('-', '_')}": _category(c) for c in CATEGORIES} | {
    "lines_explode": f"WITH {LINES_SQL} SELECT doc_id, line_no, line FROM lines",
    "match_file_scope": _FILE,
    "match_strict": _STRICT,
    "normalize_lines": f"WITH {LINES_SQL} SELECT doc_id, line_no, {_PLAIN} AS plain FROM lines WHERE {_PLAIN} <> line",
    "match_normalized": _normalized(),
    "payload_extract": f"{_EXTRACT} SELECT doc_id, line_no, kind, encoded FROM found",
    "payload_decode": f"""{_EXTRACT}, b AS (SELECT *, rtrim(encoded, '=') AS bare FROM found),
      d AS (SELECT doc_id, line_no, kind, CASE kind WHEN 'base64' THEN TRY(decode(from_base64(rpad(bare, CAST(ceil(length(bare) / 4.0) * 4 AS INT), '=')))) WHEN 'hex' THEN TRY(decode(unhex(replace(encoded, ' ', '')))) WHEN 'url' THEN TRY(decode(unhex(replace(encoded, '%', ''))))
      ELSE array_to_string(list_transform(regexp_extract_all(encoded, 'u([0-9A-Fa-f]{{4}})', 1), lambda u: chr(CAST('0x' || u AS INT))), '') END AS decoded FROM b)
      SELECT doc_id, line_no, kind, decoded FROM d WHERE decoded IS NOT NULL""",
    "fewshot_pairs": f"WITH {_exchanges('SELECT conv_id, turn AS place, CASE role WHEN ' + q('user') + ' THEN ' + q('Q') + ' WHEN ' + q('assistant') + ' THEN ' + q('A') + ' END AS kind FROM conversations', 'conv_id', 'first_turn')} SELECT conv_id, pairs, first_turn FROM p",
    "fewshot_lines": f"WITH {LINES_SQL}, {_exchanges(f'SELECT doc_id, line_no AS place, CASE WHEN regexp_matches(line, {q("(?i)" + QUESTION)}) THEN {q("Q")} WHEN regexp_matches(line, {q("(?i)" + ANSWER)}) THEN {q("A")} END AS kind FROM lines', 'doc_id', 'line_no')} SELECT doc_id, pairs, line_no FROM p WHERE pairs >= 2",
    "fence_lines": _FENCED,
    "compound_windows": f"{_WINDOWS} SELECT doc_id, line_no, mask FROM c",
    "compound_attacks": _ATTACKS,
    "noqa_lines": f"WITH {LINES_SQL} SELECT doc_id, line_no, upper(trim(unnest(string_split(ids, ',')))) AS rule_id FROM (SELECT doc_id, line_no, regexp_extract(regexp_replace(line, {q(_NOQA_STRINGS)}, '', 'g'), '(?i)#\\s*noqa:\\s*([\\w-]+(?:\\s*,\\s*[\\w-]+)*)', 1) AS ids FROM lines) WHERE ids <> ''",
    "rule_suppression": f"WITH {LINES_SQL} SELECT rule_id, count(*) AS n FROM ({hits([r for r in _LINE_RULES if r.rule_id not in ('PI-001', 'EXEC-001')])}) GROUP BY rule_id",
    "custom_rules": _CUSTOM,
    "file_safety": _SAFETY,
    "frontmatter_validate": _FRONT,
    "file_roles": f"SELECT doc_id, {_role('relative_path')} AS role FROM ({PLANTED_SQL})",
    "role_counts": f"SELECT package_id, {_role('relative_path')} AS role, count(*) AS n FROM ({PLANTED_SQL}) GROUP BY ALL",
    "operator_signals": f"WITH {_SIGNALS} SELECT package_id, file, role, rule_id, severity, driver FROM sig",
    "text_signals": f"WITH {_TEXT_SIGNALS} SELECT package_id, file, role, rule_id, severity, driver, suspicious_urls FROM sig_all",
    "risk_bands": _RISK,
    "command_snippets": _COMMANDS,
    "url_signals": _URLS,
    "remote_source_validate": _REMOTE,
    "severity_counts": f"{_MARKED} SELECT package_id, severity, count(*) AS n FROM marked GROUP BY ALL",
    "verdict": f"""{_MARKED}, f AS (SELECT package_id, count(*) FILTER (WHERE ends_with(relative_path, '.exe')) AS skipped FROM planted GROUP BY package_id),
      w AS (SELECT package_id, max({_RANK}) AS worst, count(*) AS n FROM marked GROUP BY package_id)
      SELECT package_id, coalesce(n, 0) AS n, CASE WHEN worst >= 3 THEN 'block' WHEN worst >= 1 OR skipped > 0 THEN 'flag' ELSE 'pass' END AS verdict FROM f LEFT JOIN w USING (package_id)""",
    "fail_on": f"{_MARKED} SELECT package_id, CASE WHEN package_id IN (SELECT package_id FROM marked WHERE severity = 'critical') THEN 2 ELSE 0 END AS code FROM (SELECT DISTINCT package_id FROM planted)",
    "risk_points": f"""{_MARKED}, {_TEXT_SIGNALS}, s AS (SELECT package_id, {_DRIVER} AS driver, severity, {_role('relative_path')} AS role FROM marked UNION ALL SELECT package_id, driver, severity, role FROM sig_all)
      SELECT package_id, driver, CAST(sum(CASE severity WHEN 'critical' THEN 10 WHEN 'high' THEN 7 WHEN 'medium' THEN 4 WHEN 'low' THEN 2 ELSE 0.5 END
        * CASE role WHEN 'entrypoint' THEN 1.4 WHEN 'script' THEN 1.35 WHEN 'config' THEN 1.1 WHEN 'support-doc' THEN 0.8 ELSE 0.35 END
        * CASE WHEN role = 'reference' AND driver IN ('operator-manipulation', 'remote-bootstrap') THEN 0.6 ELSE 1 END) AS DOUBLE) AS points FROM s GROUP BY ALL""",
    "report_groups": f"{_MARKED} SELECT package_id, rule_id, severity, count(*) AS occurrences, count(DISTINCT relative_path) AS files FROM marked GROUP BY ALL",
    "sarif_rows": f"{_MARKED} SELECT package_id, rule_id, {_LEVEL} AS level, relative_path AS uri, line_no AS start_line FROM marked",
}

#: What each of the planted Python sources must give: (source, line after the text, rule, severity, matched text), in order.
_SYNTAX = (
    (0, 2, "EXEC-002", "critical", "os.system("),
    (1, 2, "EXEC-002", "critical", "subprocess.run(shell=True)"),
    (2, 3, "EXEC-002", "critical", "dynamic dispatch ['eval']"),
    (3, 1, "EXEC-006", "high", "getattr(..., 'exec')"),
    (3, 1, "EXEC-002", "critical", "string evasion building 'exec'"),
    (3, 1, "EXEC-002", "critical", "split variable evasion building 'exec'"),
    (4, 2, "EXEC-007", "critical", "pickle.loads("),
    (5, 1, "EXEC-002", "critical", "__import__(...).system("),
    (5, 1, "EXEC-006", "high", "__import__("),
    (6, 2, "EXEC-002", "critical", "exec("),
    (6, 2, "OBFS-001", "high", "codecs.decode(..., 'rot13')"),
    (7, 2, "EXFIL-008", "critical", "subprocess.run(['curl', ...])"),
    (8, 1, "EXEC-011", "high", "__class__.__bases__.__subclasses__"),
    (9, 1, "EXEC-002", "critical", "split variable evasion building 'eval'"),
    (9, 2, "EXEC-006", "high", "getattr(..., name='eval')"),
    (10, 1, "EXEC-002", "critical", "string evasion building 'exec'"),
    (10, 1, "EXEC-002", "critical", "split variable evasion building 'exec'"),
    (10, 2, "EXEC-006", "high", "getattr(..., f='exec')"),
    (11, 3, "EXEC-002", "critical", "subprocess.Popen(**{'shell': ...})"),
    (12, 2, "EXEC-006", "high", "importlib.import_module("),
    (13, None, "AST-PARSE", "info", ""),
    (14, 1, "EXEC-002", "critical", "eval("),
    (16, 3, "EXEC-007", "critical", "yaml.load("),
)
_VALUES = ", ".join(f"({k}, {sum(x[0] == k for x in _SYNTAX[:i])}, {'NULL' if line is None else line}, {q(rule)}, {q(severity)}, {q(text)})" for i, (k, line, rule, severity, text) in enumerate(_SYNTAX))
ORACLE_SQL["python_syntax"] = f"""WITH x(k, ord, line, rule_id, severity, matched_text) AS (VALUES {_VALUES}),
p AS (SELECT doc_id, relative_path, len(string_split(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS before FROM ({PLANTED_SQL}) JOIN documents USING (doc_id))
SELECT doc_id, CAST(ord AS INT) AS ord, rule_id, severity, CAST(before + line AS INT) AS line, matched_text FROM p JOIN x ON x.k = doc_id % {len(PYTHON)} WHERE ends_with(relative_path, '.py')"""
