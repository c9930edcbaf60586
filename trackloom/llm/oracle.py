"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from trackloom.llm.chat_format import ENCODED
from trackloom.llm.license_scan import AGREE, BASE, INDEXED, MIN_SHARE, OWN

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{WORD}')"


def _listed(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_TEMPLATES = ", ".join(f"({n}, '{t.label}', {str(t.base).lower()}, {_listed(t.words)}, {_listed(t.key)}, {t.at})" for n, t in enumerate(BASE + OWN))
_LICENSES = f"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS r, {words("text")} AS w FROM documents),
    t(t, label, base, words, key, key_at) AS (VALUES {_TEMPLATES}),
    tw AS (SELECT t, base, list_contains(key, words[p]) AS in_key, p - 1 AS p, words[p] AS word FROM (SELECT *, unnest(range(1, len(words) + 1)) AS p FROM t)),
    dw AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
    lw AS (SELECT r, word, i FROM dw SEMI JOIN tw USING (word)),
    n AS (SELECT word, count(DISTINCT r) AS n FROM tw LEFT JOIN lw USING (word) GROUP BY word),
    ranked AS (
        SELECT t, word, base, row_number() OVER (PARTITION BY t ORDER BY n, word) AS k, CASE WHEN in_key THEN row_number() OVER (PARTITION BY t, in_key ORDER BY n, word) END AS kk
        FROM (SELECT t, word, any_value(base) AS base, bool_or(in_key) AS in_key FROM tw GROUP BY t, word) JOIN n USING (word)),
    chosen AS (SELECT t, word FROM ranked WHERE k <= {INDEXED} OR kk = 1),
    hit AS (SELECT r, word, i FROM lw SEMI JOIN chosen USING (word)),
    proposed AS (
        SELECT r, tw.t, i - p AS s, count(*) AS c FROM hit JOIN chosen USING (word) JOIN tw ON tw.t = chosen.t AND tw.word = hit.word GROUP BY ALL),
    m AS (
        SELECT r, label, base, s, len(list_filter(range(len(words)), lambda k: s + k >= 0 AND w[greatest(s + k, 0) + 1] = words[k + 1]))::double / len(words)::double AS share
        FROM proposed JOIN t USING (t) JOIN d USING (r)
        WHERE (base OR c >= {AGREE}) AND s + key_at >= 0 AND w[greatest(s + key_at, 0) + 1:greatest(s + key_at, 0) + len(key)] = key),
    g AS (
        SELECT r, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
            string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
        FROM m WHERE base OR share >= {MIN_SHARE} GROUP BY r)
    SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_base, 0)::bigint AS n_base, first_word::bigint AS first_word, last_word::bigint AS last_word,
        coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::double AS score
    FROM d LEFT JOIN g USING (r)"""

_NAME = "role"
for _raw, _code in ENCODED:
    _NAME = f"replace({_NAME}, chr({ord(_raw)}), '{_code}')"

ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": f"""
        WITH d AS (SELECT doc_id, {words("text")} AS w FROM documents),
        i AS (SELECT item_id, {words("text")} AS w FROM benchmark),
        windows AS (
            SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS win
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT size FROM windows),
        places AS (
            SELECT doc_id, size, s, array_to_string(w[s:s + size - 1], ' ') AS win
            FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes)),
        hits AS (SELECT doc_id, s, size, item_id FROM places JOIN windows USING (size, win)),
        covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM hits) GROUP BY doc_id),
        listed AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT doc_id, item_id::varchar AS item FROM hits) GROUP BY doc_id)
        SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
            sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)""",
    "op3_license_scan": _LICENSES,
    "op4_chat_format": rf"""
        WITH t AS (
            SELECT conv_id, turn, coalesce({_NAME}, '%null') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS body FROM conversations),
        o AS (
            SELECT *, row_number() OVER w AS n, ((sum(length(body) + 24) OVER w - length(body) - 24) // 1048576)::bigint AS part
            FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, body ROWS UNBOUNDED PRECEDING)),
        v AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
        p AS (
            SELECT o.conv_id, part, perspective, n, speaker = perspective AS own, body || '<|im_end|>' AS body,
                '<|im_start|>' || CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user name=' || speaker END || chr(10) AS head
            FROM v JOIN o ON v.conv_id IS NOT DISTINCT FROM o.conv_id),
        q AS (
            SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, part, perspective ORDER BY n) - length(body) - 1 AS s FROM p),
        r AS (
            SELECT conv_id, part, perspective, count(*)::bigint AS n_turns, count(*) FILTER (own)::bigint AS n_learned,
                string_agg(head || body || chr(10), '' ORDER BY n) AS rendered,
                coalesce(string_agg(s::bigint || '-' || (s + length(body))::bigint, ',' ORDER BY n) FILTER (own), '') AS spans
            FROM q GROUP BY conv_id, part, perspective)
        SELECT *, (sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY part) - length(rendered))::bigint AS start FROM r""",
    "op7_substring_dedup": r"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS n, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        p AS (SELECT n, s, sha256(array_to_string(w[s:s + 34], ' ')) AS h FROM (SELECT n, w, unnest(range(1, len(w) - 33)) AS s FROM d)),
        r AS (SELECT n, s FROM (SELECT n, s, count(*) OVER (PARTITION BY h) AS c FROM p) WHERE c > 1),
        gone AS (SELECT n, list(DISTINCT i) AS g FROM (SELECT n, unnest(range(s, s + 35)) AS i FROM r) GROUP BY n)
        SELECT doc_id, len(w)::bigint AS n_words, coalesce(len(g), 0)::bigint AS n_removed,
            sha256(coalesce(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(g, []), i)), ' '), '')) AS kept_sha256
        FROM d LEFT JOIN gone USING (n)""",
    "op9_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
            doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM d""",
    "op10_url_filter": r"""
        WITH p AS (
            SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's')) AS host,
                regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path FROM pages),
        r(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
            ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        f AS (
            SELECT page_id, arg_max(rhost || rpath, len(rhost || rpath)) AS rule, arg_max(verdict, len(rhost || rpath)) AS verdict
            FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (page_id)""",
}
