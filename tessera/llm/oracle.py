"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from tessera.llm.decontaminate import THRESHOLD, WIDTH
from tessera.llm.pii import BASE, CONFIRMING, IBAN_LENGTHS, KINDS, RAISE, REACH


def _pii() -> str:
    def spans(kind: str, plain: str, score: float, context: str) -> str:
        digits = "regexp_replace(m, '[^0-9]', '', 'g')"
        compact = "replace(m, ' ', '')"
        luhn = f"(list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {digits}[-i]::INT WHEN {digits}[-i]::INT > 4 THEN 2 * {digits}[-i]::INT - 9 ELSE 2 * {digits}[-i]::INT END)) % 10 = 0)"
        lengths = "map {" + ", ".join(f"'{c}': {n}" for c, n in IBAN_LENGTHS.items()) + "}"
        mod = f"(list_reduce(list_transform(string_split(substring({compact}, 5) || substring({compact}, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c::INT ELSE ascii(c) - 55 END), lambda a, x: (a * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1)"
        good = {
            "email": "true",
            "ip": "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR try_cast(p AS HUGEINT) > 255)) = 0",
            "card": f"(length({digits}) BETWEEN 13 AND 19 AND {luhn})",
            "phone": f"length({digits}) BETWEEN 9 AND 15",
            "key": "true",
            "secret": "(regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND length(m) <= 512)",
            "iban": f"coalesce(length({compact}) = {lengths}[substring({compact}, 1, 2)] AND {mod}, false)",
        }[kind]
        return f"""
        {kind}_raw AS (SELECT doc_id, regexp_extract_all(t, '{plain}') ms, string_split_regex(t, '{plain}') gs FROM d),
        {kind}_at AS (SELECT doc_id, unnest(ms) m, unnest(range(1, len(ms) + 1)) i, gs, ms FROM {kind}_raw WHERE len(ms) > 0),
        {kind}_span AS (SELECT doc_id, '{kind}' kind, m, i,
            (list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda g: length(g))), 0))::BIGINT AS a FROM {kind}_at),
        {kind}_near AS (SELECT {kind}_span.*, regexp_matches(t[greatest(a - {REACH}, 0) + 1:a], '{context}') near FROM {kind}_span JOIN d USING (doc_id)),
        {kind}_ok AS (SELECT doc_id, kind, a, a + length(m) AS b, {score} + CASE WHEN near THEN {RAISE} ELSE 0 END score FROM {kind}_near WHERE {good}{" AND near" if kind in CONFIRMING else ""})"""

    parts = ",".join(spans(k.name, k.plain, k.score, k.context) for k in KINDS)
    order = "CASE kind " + " ".join(f"WHEN '{k.name}' THEN {i}" for i, k in enumerate(KINDS)) + " END, a"
    union = " UNION ALL ".join(f"SELECT * FROM {k.name}_ok" for k in KINDS)
    written = "kind || ':' || a || ':' || b"
    base = "kind IN (" + ", ".join(f"'{k}'" for k in BASE) + ")"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') t FROM documents), {parts},
    found AS ({union}),
    by_doc AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') n_{k}" for k in BASE)},
        coalesce(string_agg({written}, ',' ORDER BY {order}) FILTER ({base}), '') base,
        coalesce(string_agg({written}, ',' ORDER BY {order}), '') spans, max(score) top FROM found GROUP BY doc_id)
    SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT n_{k}" for k in BASE)}, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans, round(coalesce(top, 0), 2)::DOUBLE max_score
    FROM d LEFT JOIN by_doc USING (doc_id)"""


def _leaks() -> str:
    words = lambda t: f"list_filter(regexp_split_to_array(lower(coalesce({t}, '')), '\\s+'), lambda w: w <> '')"
    cut = lambda a, start: f"array_to_string({a}[{start} + 1:{start} + width], ' ')"
    return f"""
    WITH items AS (SELECT item_id, {words("text")} w FROM benchmark WHERE item_id IS NOT NULL),
    sized AS (SELECT item_id, w, len(w) n_words, least(len(w), {WIDTH}) width FROM items WHERE len(w) > 0),
    placed AS (SELECT item_id, n_words, width, o AS "offset", {cut("w", "o")} s
        FROM (SELECT *, unnest(range(0, n_words - width + 1)) o FROM sized)),
    total AS (SELECT count(DISTINCT item_id) n FROM sized),
    weights AS (SELECT s, round(1000 * ln(1 + any_value(n) / count(DISTINCT item_id)))::BIGINT weight FROM placed, total GROUP BY s),
    item_sets AS (SELECT DISTINCT item_id, n_words, width, s, weight FROM placed JOIN weights USING (s)),
    masses AS (SELECT item_id, n_words, width, sum(weight) mass FROM item_sets GROUP BY ALL),
    docs AS (SELECT doc_id, {words("text")} w FROM documents WHERE doc_id IS NOT NULL),
    widths AS (SELECT DISTINCT width FROM sized),
    seen AS (SELECT doc_id, n, width, pos, {cut("w", "pos")} s
        FROM (SELECT doc_id, w, len(w) n, width, unnest(range(0, len(w) - width + 1)) pos FROM docs, widths)),
    starts AS (SELECT DISTINCT doc_id, item_id, n_words, p.width, greatest(0, least(pos - "offset", n - n_words)) start
        FROM seen JOIN placed p ON seen.s = p.s AND seen.width = p.width),
    windows AS (SELECT DISTINCT doc_id, n_words, width, start FROM starts),
    sets AS (SELECT DISTINCT doc_id, n_words, width, start, {cut("part", "o")} s
        FROM (SELECT *, unnest(range(0, len(part) - width + 1)) o
              FROM (SELECT windows.*, w[start + 1:start + n_words] part FROM windows JOIN docs USING (doc_id)))),
    weighed AS (SELECT sets.*, coalesce(weight, (SELECT round(1000 * ln(1 + n))::BIGINT FROM total)) weight FROM sets LEFT JOIN weights USING (s)),
    window_masses AS (SELECT doc_id, n_words, width, start, sum(weight) window_mass FROM weighed GROUP BY ALL),
    shared AS (SELECT x.doc_id, x.item_id, x.n_words, x.width, x.start, sum(a.weight) common FROM
        (SELECT DISTINCT w.doc_id, i.item_id, w.n_words, w.width, w.start FROM windows w JOIN starts i USING (doc_id, n_words, width)) x
        JOIN weighed a USING (doc_id, n_words, width, start) JOIN item_sets i ON i.item_id = x.item_id AND i.n_words = x.n_words AND i.s = a.s GROUP BY ALL),
    scored AS (SELECT doc_id, item_id, start, n_words, common / (window_mass + mass - common) similarity
        FROM shared JOIN masses USING (item_id, n_words, width) JOIN window_masses USING (doc_id, n_words, width, start))
    SELECT doc_id, item_id, start::INT start, n_words::INT n_words, round(similarity, 6) similarity FROM scored WHERE similarity >= {THRESHOLD}
    QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start, n_words) = 1"""


ORACLE: dict[str, str] = {"op1_decontaminate": _leaks(), "op6_pii": _pii()}
