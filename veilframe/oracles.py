"""SQL that computes the same as the value detectors, in another way: relations of digit runs instead of a reader.

A text is cut into characters, digit runs are islands of them, and chains of up to five neighbouring runs are made by a
recursive join. A kind of number is a condition on a chain's digits and breaks.
"""

from __future__ import annotations

from veilframe.operators import values as V

SEG = "seg AS (SELECT DISTINCT ON (seg_key) seg_key, doc_id, seg_id, ord, part, kind, text, table_ctx, pieces FROM segments)"
_B = V.BLANKS
_DASH = "-–—.·"
_PLAIN = lambda x: f"translate({x}, '０１２３４５６７８９', '0123456789')"
_CTX = lambda words: "'(?i)" + "|".join(w.replace(".", "[.]") for w in words.split()) + "'"

#: Runs of digits of every segment, with the separator to the next one ('dash', 'blank' or '').
RUNS = f"""{SEG},
txt AS (SELECT seg_key, text, pieces, CASE WHEN length(table_ctx.header_text) > 0 THEN table_ctx.header_text || ' ' || text ELSE text END AS ctx FROM seg WHERE trim(text, ' ') <> ''),
chars AS (SELECT seg_key, unnest(range(1, length(text) + 1)) AS i, text FROM txt WHERE regexp_matches(text, '\\p{{Nd}}')),
dig AS (SELECT seg_key, i, i - row_number() OVER (PARTITION BY seg_key ORDER BY i) AS g FROM chars WHERE regexp_matches(substr(text, i, 1), '\\p{{Nd}}')),
run0 AS (SELECT seg_key, min(i) - 1 AS a, max(i) AS b FROM dig GROUP BY seg_key, g),
run1 AS (SELECT r.*, t.text, row_number() OVER (PARTITION BY r.seg_key ORDER BY a) AS n, lead(a) OVER (PARTITION BY r.seg_key ORDER BY a) AS na FROM run0 r JOIN txt t USING (seg_key)),
run AS (SELECT seg_key, n, a, b, b - a AS len, {_PLAIN('substr(text, a + 1, b - a)')} AS d, text, na, trim(substr(text, b + 1, na - b), '{_B}') AS bare,
  CASE WHEN na IS NULL OR na - b > 12 THEN '' WHEN trim(substr(text, b + 1, na - b), '{_B}') = '' THEN 'blank' WHEN length(trim(substr(text, b + 1, na - b), '{_B}')) = 1 AND contains('{_DASH}', trim(substr(text, b + 1, na - b), '{_B}')) THEN 'dash' ELSE '' END AS gap FROM run1)"""
#: Chains of neighbouring runs: first and last run, their digits, where they break, how each break looks.
CHAINS = """chain AS (SELECT seg_key, n AS f, n AS l, a, b, d, len AS total, CAST([] AS BIGINT[]) AS cuts, CAST([] AS VARCHAR[]) AS gaps, gap AS nextgap FROM run
  UNION ALL SELECT c.seg_key, c.f, r.n, c.a, r.b, c.d || r.d, c.total + r.len, list_append(c.cuts, c.total), list_append(c.gaps, c.nextgap), r.gap FROM chain c JOIN run r ON r.seg_key = c.seg_key AND r.n = c.l + 1
  WHERE c.nextgap <> '' AND c.total + r.len <= 18 AND r.n - c.f < 5)"""
_LUHN = lambda d: f"list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr({d}, length({d}) - i + 1, 1) AS INT) ELSE (CAST(substr({d}, length({d}) - i + 1, 1) AS INT) * 2) // 10 + (CAST(substr({d}, length({d}) - i + 1, 1) AS INT) * 2) % 10 END)) % 10 = 0"
_AT = lambda d, i: f"CAST(substr({d}, {i}, 1) AS INT)"
_SUM = lambda d, ws: " + ".join(f"{_AT(d, i + 1)} * {w}" for i, w in enumerate(ws))
_DAYS = "CASE WHEN CAST(substr({0},3,2) AS INT) = 2 THEN 29 WHEN CAST(substr({0},3,2) AS INT) IN (4,6,9,11) THEN 30 ELSE 31 END"
_BIRTH = lambda d: f"(CAST(substr({d},3,2) AS INT) BETWEEN 1 AND 12 AND CAST(substr({d},5,2) AS INT) BETWEEN 1 AND {_DAYS.format(d)})"
_RRN_OK = f"(11 - ({_SUM('d', [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5])}) % 11) % 10 = {_AT('d', 13)}"
_BIZ_OK = f"(10 - ({_SUM('d', [1, 3, 7, 1, 3, 7, 1, 3, 5])} + {_AT('d', 9)} * 5 // 10) % 10) % 10 = {_AT('d', 10)}"
_CORP_OK = f"(10 - ({_SUM('d', [1, 2] * 6)}) % 10) % 10 = {_AT('d', 13)}"
_RRN_LIKE = f"(length(d) = 13 AND substr(d, 7, 1) <> '0' AND {_BIRTH('d')})"


def _within(lengths: tuple[int, ...], apart: bool = False) -> str:
    """A chain of these lengths breaks only between them (apart: at each)."""
    ends = [sum(lengths[: i + 1]) for i in range(len(lengths) - 1)]
    inside = f"total = {sum(lengths)} AND len(list_filter(cuts, lambda c: NOT list_contains({ends}, c))) = 0"
    return inside + (f" AND len(cuts) = {len(ends)}" if apart else "")


def _greedy(source: str, out: str) -> str:
    """Of rows (seg_key, f, l, ...) from left to right those that share no run, as a recursive relation."""
    return f"""{out}_k AS (SELECT seg_key, min(f) AS f FROM {source} GROUP BY seg_key
  UNION ALL SELECT o.seg_key, min(o.f) FROM {out}_k k JOIN {source} p ON p.seg_key = k.seg_key AND p.f = k.f JOIN {source} o ON o.seg_key = k.seg_key AND o.f > p.l GROUP BY o.seg_key),
{out} AS (SELECT s.* FROM {source} s JOIN {out}_k k ON k.seg_key = s.seg_key AND k.f = s.f)"""


_FREE = "len(list_filter(coalesce(t.pieces, []), lambda p: p.start_pos < x.e AND x.s < p.start_pos + p.length AND NOT coalesce(p.editable, true) AND NOT coalesce(p.soft, false))) = 0"


def _give(source: str) -> str:
    """Rows as the query gives them, from (seg_key, s, e, category, grade, note)."""
    return f"SELECT x.seg_key, CAST(x.s AS INT) AS start_pos, CAST(x.e AS INT) AS end_pos, x.category, x.grade, x.note, substr(t.text, x.s + 1, x.e - x.s) AS value FROM ({source}) x JOIN txt t USING (seg_key) WHERE {_FREE}"


_SURE, _LIKELY = f"'{V.CERTAIN}'", f"'{V.LIKELY}'"
_RRN_NOTE = f"CASE WHEN substr(d, 7, 1) IN ('5','6','7','8') THEN '{V.NOTE_FOREIGN}' WHEN {_RRN_OK} THEN '{V.NOTE_OK}' ELSE '{V.NOTE_RRN_BAD}' END"
_RRN_KIND = "CASE WHEN substr(d, 7, 1) IN ('5','6','7','8') THEN 'foreign_id' ELSE 'rrn' END"
L1 = {
    "l1_rrn": f"""WITH RECURSIVE {RUNS}, {CHAINS}, hit AS (SELECT c.* FROM chain c JOIN run r ON r.seg_key = c.seg_key AND r.n = c.f WHERE (len(cuts) = 0 AND total = 13 OR cuts = [6] AND total = 13 AND contains('-–—', r.bare) AND r.bare <> ''))
{_give(f"SELECT seg_key, a AS s, b AS e, {_RRN_KIND} AS category, CASE WHEN len(cuts) = 1 OR {_RRN_OK} THEN {_SURE} ELSE {_LIKELY} END AS grade, {_RRN_NOTE} AS note FROM hit WHERE {_RRN_LIKE}")}""",
    "l1_card": f"""WITH RECURSIVE {RUNS}, {CHAINS}, hit AS (SELECT * FROM chain WHERE {_within((4, 4, 4, 4))}), {_greedy('hit', 'kept')}
{_give(f"SELECT seg_key, a AS s, b AS e, 'card' AS category, {_SURE} AS grade, '{V.NOTE_LUHN}' AS note FROM kept WHERE {_LUHN('d')}")}""",
    "l1_account": f"""WITH RECURSIVE {RUNS}, {CHAINS},
sized AS (SELECT c.*, list_concat([cuts[1]], list_transform(range(1, len(cuts)), lambda i: cuts[i + 1] - cuts[i]), [total - cuts[len(cuts)]]) AS z FROM chain c JOIN txt USING (seg_key) WHERE len(cuts) IN (2, 3) AND regexp_matches(ctx, {_CTX(V.CONTEXT['account'])})),
fit AS (SELECT *, row_number() OVER (PARTITION BY seg_key, f ORDER BY l DESC) AS r FROM sized WHERE z[1] BETWEEN 2 AND 6 AND z[2] BETWEEN 2 AND 6 AND z[3] BETWEEN 2 AND 7 AND (len(z) = 3 OR z[4] BETWEEN 1 AND 6)),
hit AS (SELECT * FROM fit WHERE r = 1), {_greedy('hit', 'kept')}
{_give(f"SELECT seg_key, a AS s, b AS e, 'account' AS category, {_SURE} AS grade, '{V.NOTE_ACCOUNT}' AS note FROM kept WHERE total BETWEEN 9 AND 16 AND NOT (total = 16 AND {_LUHN('d')})")}""",
    "l1_bizno": f"""WITH RECURSIVE {RUNS}, {CHAINS}, hit AS (SELECT * FROM chain WHERE {_within((3, 2, 5), True)}), {_greedy('hit', 'kept')}, corp AS (SELECT * FROM chain WHERE {_within((6, 7), True)})
{_give(f"SELECT seg_key, a AS s, b AS e, 'bizno' AS category, CASE WHEN {_BIZ_OK} THEN {_SURE} ELSE {_LIKELY} END AS grade, CASE WHEN {_BIZ_OK} THEN '{V.NOTE_OK}' ELSE '{V.NOTE_BAD}' END AS note FROM kept UNION ALL SELECT seg_key, a, b, 'corpno', {_SURE}, '{V.NOTE_OK}' FROM corp WHERE {_CORP_OK} AND NOT {_RRN_LIKE}")}""",
    "l1_passport": f"""WITH {RUNS}
{_give(f"SELECT seg_key, a - 1 AS s, b AS e, 'passport' AS category, CASE WHEN regexp_matches(ctx, {_CTX(V.CONTEXT['passport'])}) THEN {_SURE} ELSE {_LIKELY} END AS grade, '' AS note FROM run JOIN txt USING (seg_key) WHERE len = 8 AND a > 0 AND contains('MSRODmsrod', substr(run.text, a, 1)) AND NOT (a > 1 AND regexp_matches(substr(run.text, a - 1, 1), '[A-Z0-9]')) AND NOT regexp_matches(substr(run.text, b + 1, 1), '[A-Z0-9]')")}""",
    "l1_driver": f"""WITH RECURSIVE {RUNS}, {CHAINS}, own AS (SELECT chain.*, text FROM chain JOIN txt USING (seg_key) WHERE regexp_matches(ctx, {_CTX(V.CONTEXT['driver'])})),
one AS (SELECT seg_key, f, l, a AS s, b AS e FROM own WHERE {_within((2, 2, 6, 2))}), two AS (SELECT seg_key, f, l, a, b, regexp_extract(substr(text, 1, a), '([가-힣]{{2}}[{_B}]*[{_DASH[1:]}\\-]?[{_B}]*)$', 1) AS lead FROM own WHERE {_within((2, 6, 2))}),
hit AS (SELECT * FROM one UNION ALL SELECT seg_key, f, l, a - length(lead), b FROM two WHERE lead <> '' AND NOT EXISTS (SELECT 1 FROM one WHERE one.seg_key = two.seg_key AND one.f = two.f)), {_greedy('hit', 'kept')}
{_give(f"SELECT seg_key, s, e, 'driver' AS category, {_SURE} AS grade, '' AS note FROM kept")}""",
    "l1_vehicle": f"""WITH {RUNS}
{_give(f"SELECT r.seg_key, r.a AS s, n.b AS e, 'vehicle' AS category, {_SURE} AS grade, '' AS note FROM run r JOIN run n ON n.seg_key = r.seg_key AND n.n = r.n + 1 JOIN txt x ON x.seg_key = r.seg_key WHERE r.len IN (2, 3) AND n.len = 4 AND regexp_full_match(substr(r.text, r.b + 1, n.a - r.b), '[가-힣]\\s?') AND regexp_matches(x.ctx, {_CTX(V.CONTEXT['vehicle'])})")}""",
    "l1_birth": f"""WITH {RUNS}, mark AS (SELECT r.seg_key, r.a, p.b, r.d AS y, m.d AS mm, p.d AS dd, p.text, r.bare AS k1, m.bare AS k2, r.len AS l1, m.len AS l2, p.len AS l3 FROM run r JOIN run m ON m.seg_key = r.seg_key AND m.n = r.n + 1 JOIN run p ON p.seg_key = r.seg_key AND p.n = r.n + 2 JOIN txt x ON x.seg_key = r.seg_key WHERE regexp_matches(x.ctx, {_CTX(V.CONTEXT['birth'])})),
day AS (SELECT *, try_cast(y || '-' || lpad(mm, 2, '0') || '-' || lpad(dd, 2, '0') AS DATE) AS day, regexp_extract(substr(text, b + 1, 8), '^[{_B}]*일') AS tail FROM mark WHERE l1 = 4 AND l2 <= 2 AND l3 <= 2 AND k1 IN ('.', '-', '/', '년') AND k2 IN ('.', '-', '/', '월'))
{_give(f"SELECT seg_key, a AS s, b + length(tail) AS e, 'birth' AS category, {_SURE} AS grade, '{V.NOTE_BIRTH}' AS note FROM day WHERE day BETWEEN DATE '1900-01-01' AND DATE '2026-01-01'")}""",
}


def _dialled(code: str, sizes: tuple[int, ...]) -> str:
    """Conditions on a chain's digits: code, three or four, four; alternatives with and without the country code."""
    alternatives = []
    for lead in (0, 2):
        for size in sizes:
            for mid in (4, 3):
                lengths = (*((lead,) if lead else ()), size, mid, 4)
                fused = (lead + size, mid, 4)
                cuts = sorted({sum(lengths[: i + 1]) for i in range(len(lengths) - 1)} | {sum(fused[: i + 1]) for i in range(len(fused) - 1)})
                head = ("substr(d, 1, 2) = '82' AND " if lead else "") + f"regexp_full_match(substr(d, {lead + 1}, {size}), '{code}')"
                alternatives.append(f"({head} AND total = {sum(lengths)} AND len(list_filter(cuts, lambda c: NOT list_contains({cuts}, c))) = 0)")
    return " OR ".join(alternatives)


_MOBILE, _AREA = "0?1[016789]", "0(2|[3-6][1-5]|70|50[0-9])"
_INSIDE = "(?i)(" + "|".join(w.replace(".", "[.]") for w in sorted(V.INSIDE_LABELS.split(), key=len, reverse=True)) + f")[{_B}]*(번호)?[{_B}]*[:：]?[{_B}]*$"
_SPOKEN_GAP = f"[{_B}{_DASH[1:]}\\-]*"


def _numbers(name: str, code: str, sizes: tuple[int, ...]) -> str:
    """Relation ``name``: numbers with a code, by chain or with the code in brackets and a dash, from left to right."""
    return f"""{name}_c AS (SELECT seg_key, f, l, a - CASE WHEN substr(d, 1, 2) = '82' AND substr(text, a, 1) = '+' THEN 1 ELSE 0 END AS s, b AS e, total FROM chain JOIN txt USING (seg_key) WHERE {_dialled(code, sizes)}),
{name}_b AS (SELECT r.seg_key, r.n AS f, c.l, r.a - 1 AS s, c.b AS e, c.total FROM run r JOIN chain c ON c.seg_key = r.seg_key AND c.f = r.n + 1 WHERE substr(r.text, r.a, 1) = '(' AND substr(r.text, r.b + 1, 1) = ')' AND regexp_full_match(r.d, '{code}')
  AND trim(substr(r.text, r.b + 2, r.na - r.b - 1), '{_B}') = '' AND len(c.cuts) = 1 AND c.gaps[1] = 'dash' AND c.cuts[1] IN (3, 4) AND c.total - c.cuts[1] = 4),
{name}_p AS (SELECT r.seg_key, r.n AS f, b.l, r.a - CASE WHEN substr(r.text, r.a, 1) = '+' THEN 1 ELSE 0 END AS s, b.e, 99 AS total FROM run r JOIN {name}_b b ON b.seg_key = r.seg_key AND b.f = r.n + 1 WHERE r.d = '82' AND trim(substr(r.text, r.b + 1, r.na - r.b), '{_B}{_DASH}') = '('),
{name}_a AS (SELECT *, row_number() OVER (PARTITION BY seg_key, f ORDER BY total DESC) AS r FROM (SELECT * FROM {name}_c UNION ALL SELECT * FROM {name}_b UNION ALL SELECT * FROM {name}_p)),
{name}_h AS (SELECT seg_key, f, l, s, e FROM {name}_a WHERE r = 1), {_greedy(name + '_h', name)}"""


L1["l1_phone"] = f"""WITH RECURSIVE {RUNS}, {CHAINS}, {_numbers('mob', _MOBILE, (3, 2))}, {_numbers('area', _AREA, (4, 3, 2))},
said0 AS (SELECT seg_key, i - 1 AS s, regexp_extract(substr(text, i), '^(공일[공일육칠팔구]{_SPOKEN_GAP}[{V.SPOKEN_DIGITS}]{{3,4}}{_SPOKEN_GAP}[{V.SPOKEN_DIGITS}]{{4}})(?:[^{V.SPOKEN_DIGITS}]|$)', 1) AS v, text FROM (SELECT seg_key, text, unnest(range(1, length(text) + 1)) AS i FROM txt WHERE contains(text, '공일'))),
said AS (SELECT seg_key, s, s + length(v) AS e FROM said0 WHERE v <> '' AND (s = 0 OR NOT regexp_matches(substr(text, s, 1), '[가-힣]'))),
phone AS (SELECT seg_key, s, e, 'phone' AS category, {_SURE} AS grade, '' AS note FROM mob UNION ALL SELECT seg_key, s, e, 'phone', {_SURE}, '{V.NOTE_SPOKEN}' FROM said),
tel AS (SELECT seg_key, s, e, 'tel' AS category, {_SURE} AS grade, '' AS note FROM area x WHERE NOT EXISTS (SELECT 1 FROM phone p WHERE p.seg_key = x.seg_key AND p.s < x.e AND x.s < p.e)),
far AS (SELECT seg_key, n AS f, n AS l, a, b, len AS total, 0 AS k, text FROM run WHERE substr(text, a, 1) = '+' AND a > 0 AND NOT (a > 1 AND regexp_matches(substr(text, a - 1, 1), '\\p{{Nd}}')) AND len <= 3 AND substr(d, 1, 2) <> '82'
  UNION ALL SELECT f.seg_key, f.f, r.n, f.a, r.b, f.total + r.len, f.k + 1, f.text FROM far f JOIN run r ON r.seg_key = f.seg_key AND r.n = f.l + 1 WHERE r.len <= 4 AND f.k < 6 AND trim(substr(f.text, f.b + 1, r.a - f.b), '()') IN (' ', '-')),
far1 AS (SELECT *, row_number() OVER (PARTITION BY seg_key, f ORDER BY l DESC) AS r FROM far),
abroad AS (SELECT seg_key, a - 1 AS s, b + CASE WHEN substr(text, b + 1, 1) = ')' AND (SELECT substr(q.text, q.a, 1) FROM run q WHERE q.seg_key = far1.seg_key AND q.n = far1.l) = '(' THEN 1 ELSE 0 END AS e, 'tel' AS category, {_SURE} AS grade, '{V.NOTE_ABROAD}' AS note FROM far1 WHERE r = 1 AND k >= 2 AND total BETWEEN 8 AND 15),
most AS (SELECT * FROM phone UNION ALL SELECT * FROM tel), more AS (SELECT * FROM most UNION ALL SELECT * FROM abroad x WHERE NOT EXISTS (SELECT 1 FROM most p WHERE p.seg_key = x.seg_key AND p.s < x.e AND x.s < p.e)),
inside AS (SELECT seg_key, a AS s, b AS e, 'tel' AS category, {_SURE} AS grade, '{V.NOTE_INSIDE}' AS note FROM run WHERE len BETWEEN 3 AND 5 AND regexp_matches(substr(text, greatest(1, a - 19), least(a, 20)), '{_INSIDE}'))
{_give("SELECT * FROM more UNION ALL SELECT * FROM inside x WHERE NOT EXISTS (SELECT 1 FROM more p WHERE p.seg_key = x.seg_key AND p.s < x.e AND x.s < p.e)")}"""

_LBL = lambda words: "|".join(sorted(words.split(), key=len, reverse=True))
_FORMATS = "|".join("^" + f.replace("9", "\\d").replace("A", "[A-Z]") + "$" for f in V.PROJECT_FORMATS.split())
L1["l1_email"] = f"""WITH {RUNS}, sign AS (SELECT seg_key, text, unnest(range(1, length(text) + 1)) AS i FROM txt WHERE contains(text, '@')),
part AS (SELECT seg_key, i, regexp_extract(substr(text, 1, i - 1), '[A-Za-z0-9._%+\\-]+$') AS local, regexp_extract(regexp_extract(substr(text, i + 1), '^[A-Za-z0-9.\\-]+'), '^(.+[.][A-Za-z]{{2,}})', 1) AS host FROM sign WHERE substr(text, i, 1) = '@')
{_give(f"SELECT seg_key, i - 1 - length(local) AS s, i + length(host) AS e, 'email' AS category, {_SURE} AS grade, '' AS note FROM part WHERE local <> '' AND host <> ''")}"""
L1["l1_handle"] = f"""WITH {RUNS}, pos AS (SELECT seg_key, text, unnest(range(1, length(text) + 1)) AS i FROM txt WHERE regexp_matches(text, '(?i){_LBL(V.SERVICES)}|{_LBL(V.ACCOUNT_LABELS)}')),
tok AS (SELECT seg_key, text, i - 1 AS s, regexp_extract(substr(text, i), '^[A-Za-z0-9_.\\-]+') AS v FROM pos WHERE regexp_matches(substr(text, i, 1), '[A-Za-z]') AND NOT (i > 1 AND regexp_matches(substr(text, i - 1, 1), '[A-Za-z0-9_.\\-]'))),
fit AS (SELECT *, rtrim(v, '.-') AS w, substr(text, greatest(1, s - 29), least(s, 30)) AS before FROM tok WHERE length(v) BETWEEN 4 AND 30 AND substr(text, s + length(v) + 1, 1) <> '@' AND regexp_matches(rtrim(v, '.-'), '[0-9_.]')),
two AS (SELECT *, regexp_matches(before, '(?i)(?:{_LBL(V.SERVICES)})[{_B}]*(?:{_LBL(V.ACCOUNT_LABELS)})?[{_B}]*[:：]?[{_B}]*@?$') AS named, regexp_matches(before, '(^|[^A-Za-z가-힣])(?:{_LBL(V.ACCOUNT_LABELS)})[{_B}]*[:：][{_B}]*@?$') AS labelled FROM fit)
{_give(f"SELECT seg_key, s, s + length(w) AS e, 'handle' AS category, CASE WHEN named THEN {_SURE} ELSE {_LIKELY} END AS grade, CASE WHEN named THEN '{V.NOTE_SERVICE}' ELSE '{V.NOTE_LABEL}' END AS note FROM two WHERE named OR labelled")}"""
L1["l1_project_no"] = f"""WITH {RUNS}, pos AS (SELECT seg_key, text, unnest(range(1, length(text) + 1)) AS i FROM txt WHERE contains(text, '번') OR contains(text, '20')),
tok AS (SELECT seg_key, text, i - 1 AS s, regexp_extract(substr(text, i), '^[A-Za-z0-9][A-Za-z0-9_\\-]*') AS v, substr(text, greatest(1, i - 20), least(i - 1, 20)) AS before FROM pos WHERE regexp_matches(substr(text, i, 1), '[A-Za-z0-9]') AND regexp_matches(substr(text, 1, i - 1), '(^|[^A-Za-z0-9_\\-])[-_]*$')),
lab AS (SELECT seg_key, s, s + length(v) AS e FROM tok WHERE contains(text, '번호') AND length(v) BETWEEN 6 AND 25 AND regexp_matches(v, '[0-9]') AND regexp_matches(before, '(?:{_LBL(V.PROJECT_LABELS)})[{_B}]*(?:고유)?[{_B}]*번호[{_B}]*[:：]?[{_B}]*$')),
tok2 AS (SELECT seg_key, i - 1 AS s, regexp_extract(substr(text, i), '^[A-Za-z0-9][A-Za-z0-9\\-]*') AS v FROM pos WHERE contains(text, '20') AND regexp_matches(substr(text, i, 1), '[A-Za-z0-9]') AND regexp_matches(substr(text, 1, i - 1), '(^|[^A-Za-z0-9\\-])[-]*$')),
shape AS (SELECT seg_key, s, s + length(v) AS e FROM tok2 x WHERE regexp_matches(v, '{_FORMATS}') AND NOT EXISTS (SELECT 1 FROM lab l WHERE l.seg_key = x.seg_key AND l.s < x.s + length(x.v) AND x.s < l.e)),
num AS (SELECT run.seg_key, a - length(regexp_extract(substr(text, greatest(1, a - 2), least(a, 3)), '[A-Za-z]*$')) AS s, b AS e, text FROM run WHERE len BETWEEN 5 AND 12 AND NOT regexp_matches(substr(text, b + 1, 1), '[A-Za-z0-9]')),
man AS (SELECT seg_key, s, e FROM num WHERE regexp_matches(substr(text, greatest(1, s - 11), least(s, 12)), '(?:{_LBL(V.PERSON_NUMBERS)})[{_B}]*[:：(（]?[{_B}]*$'))
{_give(f"SELECT seg_key, s, e, 'project_no' AS category, {_SURE} AS grade, '{V.NOTE_NUMBER}' AS note FROM lab UNION ALL SELECT seg_key, s, e, 'project_no', {_SURE}, '{V.NOTE_FORMAT}' FROM shape UNION ALL SELECT seg_key, s, e, 'handle', {_SURE}, '{V.NOTE_PERSON_NO}' FROM man")}"""


def rule_rows() -> str:
    """Rows of the user's deny list and the three sample rules, from relations d, cash, ask and run."""
    return _give(
        f"SELECT seg_key, i - 1 AS s, i - 1 + length(v) AS e, c AS category, {_SURE} AS grade, '금칙어' AS note FROM d WHERE substr(text, i, length(v)) = v "
        f"UNION ALL SELECT run.seg_key, a, b, 'project_no', {_SURE}, 'NTIS number' FROM run JOIN txt USING (seg_key) WHERE len = 10 AND regexp_matches(txt.text, 'NTIS|과제고유번호') "
        f"UNION ALL SELECT seg_key, instr(text, m) - 1 + length(m) - length(v), instr(text, m) - 1 + length(m), 'project_no', {_SURE}, 'project number' FROM ask WHERE v <> '' "
        f"UNION ALL SELECT seg_key, s, s + length(v), 'budget', {_SURE}, 'budget' FROM cash WHERE v <> ''"
    )
