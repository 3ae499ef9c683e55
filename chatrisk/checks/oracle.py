"""DuckDB SQL for the registered queries, written from the definitions with other methods.

Positions come from row_number, frames from self-joins, repeats and slang from unnested characters
and tokens, so that a slip in a Spark expression is not repeated here.
"""

from __future__ import annotations

from chatrisk import config, views
from chatrisk.functions.text import closed_slang
from chatrisk.operators.evaluation import GRID


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows) -> str:
    cell = lambda v: q(v) if isinstance(v, str) else f"{v!r}e0" if isinstance(v, float) else repr(v)
    return "VALUES " + ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)


def sql_list(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


def in_list(items) -> str:
    return "(" + ", ".join(q(i) for i in items) + ")"


RULES = f"rules(rule_id, category, severity, pattern) AS ({values([(i, *r) for i, r in enumerate(config.RULES)])})"
WEIGHTS = f"weights(category, weight) AS ({values(config.CATEGORY_WEIGHTS.items())})"
PAIRS = f"pairs(cat_a, cat_b, bonus) AS ({values(config.PAIR_BONUSES)})"
SLANG = f"slang(word, meaning) AS ({values(closed_slang().items())})"
WORD = r"[\pL\pN_]+|[^\pL\pN_]+"


def normalised(source: str, key: str, text: str, out: str, steps: str = "all") -> list[str]:
    """CTEs that normalise source.text into out(key, norm)."""
    p = out
    return [
        f"{p}_m AS (SELECT {key}, regexp_replace(regexp_replace(regexp_replace(lower(nfc_normalize({text})), "
        rf"'https?://\S+|www\.\S+', '<URL>', 'g'), '\b[\w.+-]+@[\w-]+\.[a-z]{{2,}}\b', '<EMAIL>', 'g'), "
        rf"'\b\d[\d\s\-]{{5,13}}\d\b', '<PHONE>', 'g') AS t FROM {source})",
        f"{p}_c AS (SELECT {key}, unnest(regexp_extract_all(t, '(?s).')) AS c, "
        f"generate_subscripts(regexp_extract_all(t, '(?s).'), 1) AS pos FROM {p}_m)",
        f"{p}_r AS (SELECT {key}, string_agg(c, '' ORDER BY pos) AS t FROM (SELECT *, "
        f"lag(c, 1) OVER w AS c1, lag(c, 2) OVER w AS c2 FROM {p}_c WINDOW w AS (PARTITION BY {key} ORDER BY pos)) "
        f"WHERE NOT (c <> chr(10) AND c = coalesce(c1, '') AND c = coalesce(c2, '')) GROUP BY {key})",
        f"{p}_w AS (SELECT {key}, unnest(regexp_extract_all(t, '{WORD}')) AS w, "
        f"generate_subscripts(regexp_extract_all(t, '{WORD}'), 1) AS pos FROM {p}_r)",
        SLANG,
        f"{p}_s AS (SELECT {key}, string_agg(coalesce(meaning, w), '' ORDER BY pos) AS t "
        f"FROM {p}_w LEFT JOIN slang ON w = word GROUP BY {key})",
        f"{out} AS (SELECT m.{key}, trim(regexp_replace(coalesce(s.t, ''), '[\\s ]+', ' ', 'g')) AS norm "
        f"FROM {p}_m m LEFT JOIN {p}_s s ON m.{key} IS NOT DISTINCT FROM s.{key})",
    ]


def pick(phrases, index: str) -> str:
    return f"{sql_list(phrases)}[{index} + 1]"


EVENTS = "ev AS (SELECT *, (event_id * 7919) % 97 AS i, user_id * 6 + event_id % 6 AS conv_id FROM events)"
CHAT = [
    EVENTS,
    f"""msg AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY ts, event_id) - 1 AS INTEGER) AS conv_idx,
    conv_id || ':' || event_type AS author,
    CASE WHEN i = 96 THEN '  ' WHEN conv_id % 5 = 1 THEN {pick(views.DOUBLE, 'i % 4')}
         WHEN conv_id % 5 = 2 AND i < 60 THEN {pick(views.SINGLE, 'i % 12')}
         WHEN i < 12 THEN {pick(views.SINGLE, 'i')} ELSE {q(views.BENIGN)} END AS text_raw,
    event_type NOT IN ('view', 'click') AND conv_id % 3 <> 0 AS is_flagged FROM ev)""",
]
# Every distinct text once: its normal form and its hits.
CHAT_HITS = [
    *CHAT, "texts AS (SELECT DISTINCT text_raw FROM msg)", *normalised("texts", "text_raw", "text_raw", "normed"), RULES,
    """found AS (SELECT norm, rule_id, category, severity, regexp_extract_all(norm, pattern, 0, 'i') AS hs
    FROM (SELECT DISTINCT norm FROM normed WHERE norm <> ''), rules)""",
    """text_hits AS (SELECT norm, rule_id, category, severity, unnest(hs) AS text, generate_subscripts(hs, 1) - 1 AS hit_no FROM found)""",
    "m AS (SELECT msg.*, norm FROM msg JOIN normed USING (text_raw))",
    "live AS (SELECT * FROM m WHERE norm <> '')",
]


def scored_ctes(scope: str) -> list[str]:
    where = "WHERE is_flagged" if scope == "flagged" else ""
    return [
        f"sc AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY conv_idx) AS o, count(*) OVER (PARTITION BY conv_id) AS n FROM live {where})",
        "hits AS (SELECT sc.conv_id, sc.conv_idx, h.rule_id, h.category, h.severity, h.text, h.hit_no FROM sc JOIN text_hits h USING (norm))",
        "msev AS (SELECT conv_id, conv_idx, max(severity) AS sev, count(*) AS n_hits FROM hits GROUP BY ALL)",
        "catn AS (SELECT conv_id, category, count(DISTINCT conv_idx) AS msg_count FROM hits GROUP BY ALL)",
    ]


RISK = [
    WEIGHTS, PAIRS,
    "totals AS (SELECT conv_id, max(CAST(is_flagged AS INTEGER)) AS label, count(*) FILTER (norm <> '') AS n_messages FROM m GROUP BY 1)",
    "basic AS (SELECT conv_id, sum(coalesce(weight, 1e0) * least(msg_count, 3)) AS base, string_agg(category, ',' ORDER BY category) AS cats FROM catn LEFT JOIN weights USING (category) GROUP BY 1)",
    "co AS (SELECT a.conv_id, sum(bonus) AS cooccur FROM pairs JOIN catn a ON a.category = cat_a JOIN catn b ON b.category = cat_b AND a.conv_id = b.conv_id GROUP BY 1)",
    """half AS (SELECT conv_id, max(n) AS n, coalesce(max(sev) FILTER (o <= n // 2), 0) AS early, coalesce(max(sev) FILTER (o > n // 2), 0) AS late,
    coalesce(sum(n_hits), 0) AS total_hits FROM sc LEFT JOIN msev USING (conv_id, conv_idx) GROUP BY 1)""",
    "esc AS (SELECT conv_id, CASE WHEN n >= 4 AND late > early THEN 3e0 + CASE WHEN early <= 1 AND late = 3 THEN 1.5e0 ELSE 0e0 END ELSE 0e0 END AS escal FROM half)",
    f"""thirds AS (SELECT conv_id, bool_or(o <= greatest(n // 3, 1) AND category IN {in_list(config.TRUST)}) AS t,
    bool_or(o > n - greatest(n // 3, 1) AND category IN {in_list(config.SOLICIT)}) AS s, bool_or(category IN {in_list(config.CONTROL)}) AS c,
    max(n) AS n FROM sc JOIN hits USING (conv_id, conv_idx) GROUP BY 1)""",
    "arcs AS (SELECT conv_id, CASE WHEN n >= 6 AND t AND s THEN 2.5e0 + CASE WHEN c THEN 1e0 ELSE 0e0 END ELSE 0e0 END AS arc FROM thirds)",
    "islands AS (SELECT conv_id, count(*) AS len FROM (SELECT conv_id, conv_idx - o AS island FROM sc) GROUP BY conv_id, island)",
    "runs AS (SELECT conv_id, count(*) AS n_runs FROM islands WHERE len >= 3 GROUP BY 1)",
]


def risk_ctes(scope: str) -> list[str]:
    relative = "0e0" if scope == "all" else None
    return [
        *CHAT_HITS, *scored_ctes(scope), *RISK,
        f"""parts AS (SELECT t.conv_id, t.label, t.n_messages, coalesce(h.n, 0) AS n_flagged, coalesce(h.total_hits, 0) AS total_hits,
        coalesce(base, 0e0) AS base, coalesce(cooccur, 0e0) AS cooccur, coalesce(escal, 0e0) AS escal, coalesce(arc, 0e0) AS arc,
        {relative or "CASE WHEN n_messages > 0 AND coalesce(h.n, 0) / n_messages > 0.60 THEN 1.5e0 ELSE 0e0 END"} AS dominance,
        CASE WHEN coalesce(h.n, 0) > 0 AND h.total_hits / h.n > 1.5 THEN 2e0 ELSE 0e0 END AS density,
        {relative or "coalesce(n_runs, 0) * 0.5e0"} AS consec, coalesce(cats, '') AS cats
        FROM totals t LEFT JOIN half h USING (conv_id) LEFT JOIN basic USING (conv_id) LEFT JOIN co USING (conv_id)
        LEFT JOIN esc USING (conv_id) LEFT JOIN arcs USING (conv_id) LEFT JOIN runs USING (conv_id))""",
        "scores AS (SELECT *, base + cooccur + escal + arc + dominance + density + consec AS score FROM parts)",
        "risk AS (SELECT *, CASE WHEN score >= 6.0 THEN 'HIGH' WHEN score >= 2.5 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM scores)",
    ]


def text_ctes(scope: str) -> list[str]:
    role = "CASE WHEN is_flagged THEN '[PRED]' ELSE '[USER]' END" if scope == "flagged" else "'[USER]'"
    return [
        *risk_ctes(scope),
        "tag1 AS (SELECT conv_id, conv_idx, category, severity, min(rule_id) AS r FROM hits GROUP BY ALL)",
        "tags AS (SELECT conv_id, conv_idx, string_agg('[RULE:' || category || ':' || severity || ']', ' ' ORDER BY r) || ' ' AS tags FROM tag1 GROUP BY 1, 2)",
        f"""body AS (SELECT conv_id, string_agg({role} || ' ' || coalesce(tags, '') || norm, ' [SEP] ' ORDER BY conv_idx) AS body
        FROM live LEFT JOIN tags USING (conv_id, conv_idx) GROUP BY 1)""",
        """dataset AS (SELECT conv_id AS conversation_id, label, '[RISK:' || level || '] [CATS:' || CASE WHEN cats = '' THEN 'none' ELSE cats END || ']'
        || ' [ESC:' || CAST(escal > 0 AS INTEGER) || '] [ARC:' || CAST(arc > 0 AS INTEGER) || '] [DOM:' || CAST(dominance > 0 AS INTEGER) || ']'
        || coalesce(' ' || body, '') AS text, level, escal, arc, dominance, cats FROM risk LEFT JOIN body USING (conv_id))""",
    ]


SPLIT_EXACT = """split AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5(conversation_id || '|42'), CAST(conversation_id AS VARCHAR))
    <= floor(count(*) OVER (PARTITION BY label) * 0.1 + 0.5) THEN 'val' ELSE 'train' END AS split FROM dataset)"""

# Reports read what the tags say: one count per message, category and severity.
RECORDS = [
    *text_ctes("flagged"),
    "tagn AS (SELECT conv_id, category, count(*) AS n, count(*) FILTER (severity = 3) AS n3, min(conv_idx * 1000 + r) AS firstpos FROM tag1 GROUP BY 1, 2)",
    "tagsum AS (SELECT conv_id, sum(n) AS total_rule_hits, sum(n3) AS sev3_hits FROM tagn GROUP BY 1)",
    """rec AS (SELECT r.conv_id AS conversation_id, label, CASE WHEN label = 1 THEN 'GROOMING' ELSE 'benign' END AS label_str, level AS risk_level,
    CASE level WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END AS risk_order, escal > 0 AS escalation, arc > 0 AS arc,
    dominance > 0 AS dominance, cats AS categories, CAST(CASE WHEN cats = '' THEN 0 ELSE len(string_split(cats, ',')) END AS INTEGER) AS n_categories,
    CAST(coalesce(total_rule_hits, 0) AS INTEGER) AS total_rule_hits, CAST(coalesce(sev3_hits, 0) AS INTEGER) AS sev3_hits,
    CAST(n_messages AS INTEGER) AS n_messages FROM risk r LEFT JOIN tagsum USING (conv_id))""",
]


def contact_ctes(key: str = "contact_id", extra: str = "") -> list[str]:
    """Window figures by self-join on positions; `key` may be several columns."""
    keys = [k.strip() for k in key.split(",")]
    same = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    cols = ", ".join(f"a.{k}" for k in keys)
    half = "greatest(n // 3, 1)"
    return [
        EVENTS, RULES, WEIGHTS, PAIRS,
        f"""base_msg AS (SELECT user_id AS contact_id, ts, event_id AS msg_id{extra}, event_type NOT IN ('view', 'click') AS ext,
        least(value / 125.0, 1.0) AS p, CASE WHEN i < 12 THEN {pick(views.SINGLE, 'i')} ELSE {q(views.BENIGN)} END AS text FROM ev)""",
        f"cm AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ts, msg_id) AS rn FROM base_msg)",
        """th AS (SELECT text, rule_id, category, severity, unnest(regexp_extract_all(text, pattern, 0, 'i')) AS hit
        FROM (SELECT DISTINCT text FROM base_msg), rules)""",
        "tsev AS (SELECT text, max(severity) AS sev FROM th GROUP BY 1)",
        f"""fr AS (SELECT {cols}, a.msg_id AS at_id, b.msg_id, b.rn, b.ext, b.p, b.text, coalesce(tsev.sev, 0) AS sev
        FROM cm a JOIN cm b ON {same} AND b.rn BETWEEN a.rn - 29 AND a.rn LEFT JOIN tsev ON tsev.text = b.text)""",
        """ex AS (SELECT *, row_number() OVER (PARTITION BY at_id ORDER BY rn) AS o, count(*) OVER (PARTITION BY at_id) AS n FROM fr WHERE ext)""",
        """cnts AS (SELECT at_id, count(*) AS window_len, count(*) FILTER (ext) AS n_external, count(*) FILTER (ext AND p >= 0.80) AS high_risk_count,
        count(*) FILTER (ext AND (p >= 0.60 OR sev >= 2)) AS risky_count, string_agg(CASE WHEN ext THEN 'E' ELSE 'C' END, '' ORDER BY rn) AS pattern
        FROM fr GROUP BY 1)""",
        "runs AS (SELECT at_id, len(regexp_extract_all(pattern, 'E{3,}')) * 0.5e0 AS consec FROM cnts)",
        "tc AS (SELECT DISTINCT text, category FROM th)",
        "fc AS (SELECT at_id, category, count(*) AS k FROM ex JOIN tc USING (text) GROUP BY 1, 2)",
        "bs AS (SELECT at_id, sum(coalesce(weight, 1e0) * least(k, 3)) AS base, string_agg(category, ', ' ORDER BY category) AS cats FROM fc LEFT JOIN weights USING (category) GROUP BY 1)",
        "co AS (SELECT x.at_id, sum(bonus) AS cooccur FROM pairs JOIN fc x ON x.category = cat_a JOIN fc y ON y.category = cat_b AND x.at_id = y.at_id GROUP BY 1)",
        """es AS (SELECT at_id, CASE WHEN max(n) >= 4 AND coalesce(max(sev) FILTER (o > n // 2), 0) > coalesce(max(sev) FILTER (o <= n // 2), 0)
        THEN 3e0 + CASE WHEN coalesce(max(sev) FILTER (o <= n // 2), 0) <= 1 AND max(sev) FILTER (o > n // 2) = 3 THEN 1.5e0 ELSE 0e0 END ELSE 0e0 END AS escal FROM ex GROUP BY 1)""",
        f"""ar AS (SELECT at_id, CASE WHEN max(n) >= 6 AND bool_or(o <= {half} AND category IN {in_list(config.TRUST)}) AND bool_or(o > n - {half} AND category IN {in_list(config.SOLICIT)})
        THEN 2.5e0 + CASE WHEN bool_or(category IN {in_list(config.CONTROL)}) THEN 1e0 ELSE 0e0 END ELSE 0e0 END AS arc FROM ex JOIN tc USING (text) GROUP BY 1)""",
        """win AS (SELECT cm.*, coalesce(tsev.sev, 0) AS max_severity, c.window_len, c.n_external, c.high_risk_count, c.risky_count, coalesce(base, 0e0) AS base,
        coalesce(cooccur, 0e0) AS cooccur, coalesce(escal, 0e0) AS escal, coalesce(arc, 0e0) AS arc, consec, coalesce(cats, '') AS cats,
        coalesce(base, 0e0) + coalesce(cooccur, 0e0) + coalesce(escal, 0e0) + coalesce(arc, 0e0) + consec AS score
        FROM cm JOIN cnts c ON c.at_id = msg_id JOIN runs ON runs.at_id = msg_id LEFT JOIN bs ON bs.at_id = msg_id LEFT JOIN co ON co.at_id = msg_id
        LEFT JOIN es ON es.at_id = msg_id LEFT JOIN ar ON ar.at_id = msg_id LEFT JOIN tsev ON tsev.text = cm.text)""",
        "mcats AS (SELECT text, string_agg(category, ', ' ORDER BY category) AS mc FROM tc GROUP BY 1)",
        """al0 AS (SELECT win.*, coalesce(mc, '') AS mc, CASE WHEN cats = '' THEN 'none' ELSE cats END AS wc, printf('%.1f', score) AS s1,
        CASE WHEN max_severity = 3 THEN 1 WHEN high_risk_count >= 3 THEN 2 WHEN score >= 6.0 THEN 3 WHEN risky_count >= 5 THEN 4 WHEN score >= 2.5 THEN 5 END AS branch
        FROM win LEFT JOIN mcats USING (text) WHERE ext)""",
        """al AS (SELECT *, CASE branch WHEN 1 THEN 'Critical' WHEN 2 THEN 'High' WHEN 3 THEN 'High' ELSE 'Medium' END AS level,
        CASE branch WHEN 1 THEN 'Explicit grooming indicator | cats=[' || mc || ']'
        WHEN 2 THEN 'High-confidence ML (' || high_risk_count || ' msgs >= 0.8) | score=' || s1 || ' | cats=[' || wc || ']'
        WHEN 3 THEN 'Window risk=' || s1 || ' >= 6.0 | cats=[' || wc || ']' || CASE WHEN escal > 0 AND arc > 0 THEN ' | ESCALATION, STAGE ARC'
             WHEN escal > 0 THEN ' | ESCALATION' WHEN arc > 0 THEN ' | STAGE ARC' ELSE '' END
        WHEN 4 THEN 'Sustained pattern (' || risky_count || ' msgs, score=' || s1 || ') | cats=[' || wc || ']'
        ELSE 'Window risk=' || s1 || ' >= 2.5 | cats=[' || wc || ']' END AS reason FROM al0 WHERE branch IS NOT NULL)""",
    ]


CONTACT = contact_ctes()
SCORED_ROWS = "sr AS (SELECT doc_id AS id, (n_chars % 1000) / 1000.0 AS prob, toxic AS label FROM labels JOIN documents USING (doc_id))"
GRID_ROWS = f"grid(threshold) AS (SELECT CAST(t AS DOUBLE) FROM ({values([(repr(t),) for t in GRID])}) v(t))"
GRID_METRICS = [
    SCORED_ROWS, GRID_ROWS,
    """gm AS (SELECT threshold, count(*) FILTER (prob >= threshold AND label = 1) AS tp, count(*) FILTER (prob >= threshold AND label = 0) AS fp,
    count(*) FILTER (prob < threshold AND label = 1) AS fn FROM grid, sr GROUP BY 1)""",
    """gp AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM gm)""",
    "gf AS (SELECT *, CASE WHEN 4.0 * precision + recall = 0 THEN 0.0 ELSE 5.0 * precision * recall / (4.0 * precision + recall) END AS f2 FROM gp)",
]


def sql(ctes: list[str], select: str) -> str:
    names, kept = set(), []
    for cte in ctes:  # shared pieces may be listed twice
        head = cte.split(" AS ", 1)[0]
        if head not in names:
            names.add(head)
            kept.append(cte)
    return "WITH " + ",\n".join(kept) + "\n" + select
