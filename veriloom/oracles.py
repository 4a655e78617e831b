"""DuckDB SQL with the same rows as the registered queries, built from named common table expressions."""

from __future__ import annotations

import re

from veriloom.functions import text as X

GENERIC = str(X.GENERIC)
METRIC = f"(?i)({'|'.join(X.METRIC)})"
STRENGTH_RANK = "CASE evidence_strength WHEN 'strong' THEN 1 WHEN 'moderate' THEN 2 ELSE 3 END"
STRENGTH_OF = "CASE {} WHEN 1 THEN 'strong' WHEN 2 THEN 'moderate' WHEN 3 THEN 'weak' END"
SIX = "coalesce(source_type,''), coalesce(source,''), coalesce(relationship,''), coalesce(project,''), coalesce(role,''), coalesce(education,'')"


def _slug(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '-')"


def _date(c: str) -> str:
    y, m = f"try_cast(split_part({c}, '-', 1) AS INT)", f"try_cast(nullif(split_part({c}, '-', 2), '') AS INT)"
    names = "['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec']"
    return f"CASE WHEN nullif({c}, '') IS NULL THEN NULL WHEN {y} IS NULL THEN {c} WHEN {m} BETWEEN 1 AND 12 THEN {names}[{m}] || ' ' || {y} ELSE {y}::VARCHAR END"


def _terms(c: str) -> str:
    return f"regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+')"


def _lists(*names: str, json: bool = False) -> str:
    """Lists of a left join, empty where there is none."""
    return ", ".join(f"to_json(coalesce({n}, []))::VARCHAR AS {n}" if json else f"'{n}': coalesce({n}, [])" for n in names)


CTE: dict[str, str] = {
    "skill": """SELECT name, upper(name) AS display_name, CASE WHEN len(a) > 0 THEN a END AS aliases, category FROM (
        SELECT p_name AS name, list_sort(coalesce(list(DISTINCT lower(p_brand) || ' ' || lower(p_type)) FILTER (p_size <= 2), [])) AS a,
        first(CASE WHEN split_part(p_name, ' ', -1) IN ('ring', 'widget') THEN 'technical' WHEN split_part(p_name, ' ', -1) IN ('bolt', 'gear') THEN 'tool' WHEN split_part(p_name, ' ', -1) = 'rod' THEN 'language' ELSE 'capability' END) AS category
        FROM part GROUP BY 1)""",
    "req": """SELECT 'job' || (p_partkey // 25) AS job_id, p_partkey AS seq, p_name || ' / ' || p_brand || ' / ' || p_type AS raw,
        CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN lower(p_brand) || ' ' || lower(p_type) WHEN 2 THEN p_name || ' ' || lower(p_type) WHEN 3 THEN lower(p_type) || ' engineering'
          WHEN 4 THEN split_part(p_name, ' ', -1) || ' systems' ELSE 'data management' END AS skill_query,
        ['required', 'preferred', 'inferred'][p_size % 3 + 1] AS importance, ['technology', 'capability', 'soft_skill', 'domain'][p_partkey % 4 + 1] AS category,
        CASE WHEN p_partkey % 6 = 5 THEN nxt END AS cap FROM part LEFT JOIN (SELECT p_partkey - 1 AS p_partkey, p_name AS nxt FROM part) USING (p_partkey)""",
    "app": "SELECT 'job' || (c_custkey % (SELECT max(p_partkey) // 25 + 1 FROM part)) AS job_id, c_custkey::VARCHAR AS person_id FROM customer",
    "role": """SELECT s_suppkey::VARCHAR AS role_id, s_name AS title, NULL::VARCHAR AS description, CASE s_suppkey % 3 WHEN 0 THEN '2019' WHEN 1 THEN '2019-03' END AS start_date, NULL::VARCHAR AS end_date,
        NULL::VARCHAR AS location, CASE WHEN s_suppkey % 2 = 0 THEN 'remote' END AS work_mode, CASE WHEN s_suppkey % 7 = 0 THEN 'volunteer' END AS employment_type FROM supplier""",
    "project": """SELECT o_orderkey::VARCHAR AS project_id, 'Project ' || o_orderkey AS name, CASE WHEN o_orderpriority = '5-LOW' THEN 'volunteer' END AS type, o_orderpriority AS context,
        strftime(o_orderdate, '%Y-%m-%d') AS start_date FROM orders""",
    "education": "SELECT r_regionkey::VARCHAR AS education_id, r_name AS institution, 'Studies' AS program, 'completed' AS status, 'Studies in ' || r_name AS description, '2015' AS start_date, NULL::VARCHAR AS end_date FROM region",
    "returned": """SELECT l_orderkey, l_partkey, 'Delivered ' || l_quantity::INT || CASE WHEN l_linenumber % 2 = 0 THEN ' items' ELSE ' lots' END || ' in line ' || l_linenumber || ' of order ' || l_orderkey AS description,
        CASE WHEN l_linenumber % 2 = 0 THEN l_quantity::INT || ' items' END AS metric FROM lineitem WHERE l_returnflag = 'R'""",
    "achievement": "SELECT DISTINCT description AS achievement_id, description, metric FROM returned",
    "during": "SELECT o_orderkey, o_custkey, min(l_suppkey) AS role FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' GROUP BY ALL",
    "owner": "SELECT o_orderkey, o_orderstatus, n_regionkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    "edges": """SELECT DISTINCT type, src_label, src_key::VARCHAR AS src_key, dst_label, dst_key::VARCHAR AS dst_key FROM (
        SELECT 'HAD_ROLE' AS type, 'Person' AS src_label, o_custkey::VARCHAR AS src_key, 'Role' AS dst_label, role::VARCHAR AS dst_key FROM during
        UNION ALL SELECT 'HAD_ROLE', 'Person', c_custkey::VARCHAR, 'Role', s_suppkey::VARCHAR FROM customer JOIN supplier ON c_custkey % 10 = s_suppkey
        UNION ALL SELECT 'AT', 'Role', s_suppkey::VARCHAR, 'Company', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 5 <> 0
        UNION ALL SELECT 'BUILT', 'Person', o_custkey::VARCHAR, 'Project', o_orderkey::VARCHAR FROM orders
        UNION ALL SELECT 'DURING', 'Project', o_orderkey::VARCHAR, 'Role', role::VARCHAR FROM during
        UNION ALL SELECT 'USED', 'Project', l_orderkey::VARCHAR, 'Skill', p_name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'N'
        UNION ALL SELECT 'DEMONSTRATES', 'Achievement', description, 'Skill', p_name FROM returned JOIN part ON p_partkey = l_partkey
        UNION ALL SELECT 'ACHIEVED', 'Project', l_orderkey::VARCHAR, 'Achievement', description FROM returned
        UNION ALL SELECT 'STUDIED_AT', 'Person', c_custkey::VARCHAR, 'Education', n_regionkey::VARCHAR FROM customer JOIN nation ON c_nationkey = n_nationkey
        UNION ALL SELECT 'LEARNED', 'Education', n_regionkey::VARCHAR, 'Skill', p_name FROM lineitem JOIN part ON p_partkey = l_partkey JOIN owner ON o_orderkey = l_orderkey
          WHERE l_returnflag = 'A' AND o_orderstatus = 'P' AND length(p_name) % 5 = n_regionkey
        UNION ALL SELECT 'PART_OF', 'Project', o_orderkey::VARCHAR, 'Education', n_regionkey::VARCHAR FROM owner WHERE o_orderstatus = 'P')""",
    "nodes": """SELECT 'Person' AS label, c_custkey::VARCHAR AS key, c_name AS shown FROM customer UNION ALL SELECT 'Role', role_id, title FROM role UNION ALL SELECT 'Company', n_name, n_name FROM nation
        UNION ALL SELECT 'Project', project_id, name FROM project UNION ALL SELECT 'Education', education_id, institution FROM education
        UNION ALL SELECT 'Achievement', achievement_id, left(description, 46) FROM achievement UNION ALL SELECT 'Skill', name, name FROM skill""",
    "skill_terms": f"""SELECT name AS skill, 'name' AS field, {_terms('name')} AS t FROM skill UNION ALL SELECT name, 'aliases', {_terms("array_to_string(aliases, ' ')")} FROM skill""",
    "postings": "SELECT skill, field, dl, term, count(*) AS tf FROM (SELECT skill, field, len(t) AS dl, unnest(t) AS term FROM skill_terms) GROUP BY ALL",
    "weights": """SELECT skill, term, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS w FROM postings
        JOIN (SELECT field, term, count(*) AS df FROM postings GROUP BY ALL) USING (field, term)
        JOIN (SELECT field, count(*) AS n, avg(dl) AS avgdl FROM (SELECT DISTINCT skill, field, dl FROM postings) GROUP BY ALL) USING (field) GROUP BY ALL""",
    "ranked": f"""SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, skill) AS rank FROM (
        SELECT query, skill, round(sum(w), 6) AS score FROM (SELECT query, unnest(list_distinct({_terms('query')})) AS term FROM (SELECT DISTINCT skill_query AS query FROM req UNION SELECT cap FROM req WHERE cap IS NOT NULL)) JOIN weights USING (term) GROUP BY ALL)""",
    "judged": f"""SELECT r.*, CASE WHEN lower(trim(query)) = lower(trim(skill)) THEN 'canonical_exact' WHEN list_contains(list_transform(coalesce(aliases, []), lambda a: lower(trim(a))), lower(trim(query))) THEN 'alias_exact' END AS exact,
        list_sort(list_filter(list_distinct({_terms('query')}), lambda x: list_contains(list_concat({_terms('skill')}, {_terms("array_to_string(aliases, ' ')")}), x) AND NOT list_contains({GENERIC}, x))) AS overlap,
        display_name, s.category FROM ranked r JOIN skill s ON s.name = r.skill""",
    "exacts": "SELECT query, arg_min(skill, rank) AS e_skill, arg_min(score, rank) AS e_score, arg_min(exact, rank) AS e_type FROM judged WHERE rank <= 5 AND exact IS NOT NULL GROUP BY 1",
    "overs": """SELECT * FROM (SELECT query, skill AS o_skill, score AS o_score, len(overlap) AS n, lead(score) OVER (PARTITION BY query ORDER BY rank) AS nxt, row_number() OVER (PARTITION BY query ORDER BY rank) AS k
        FROM judged WHERE rank <= 5 AND len(overlap) > 0) WHERE k = 1""",
    "resolved": """SELECT query, coalesce(e_skill, o_skill) AS canonical_skill, coalesce(e_score, o_score) AS match_score,
        CASE WHEN e_skill IS NOT NULL THEN 'high' WHEN n IS NULL THEN 'no_match' WHEN n < 2 THEN 'low' WHEN nxt IS NULL OR (o_score > 0 AND nxt / o_score < 0.7) THEN 'high' ELSE 'low' END AS match_confidence,
        CASE WHEN e_skill IS NOT NULL THEN e_type WHEN n IS NULL THEN 'no_match' WHEN n < 2 THEN 'lexical_single_token' ELSE 'lexical_multi_token' END AS match_type
        FROM (SELECT DISTINCT skill_query AS query FROM req UNION SELECT cap FROM req WHERE cap IS NOT NULL) LEFT JOIN exacts USING (query) LEFT JOIN overs USING (query)""",
    "rec": """SELECT *, CASE WHEN match_type IN ('canonical_exact', 'alias_exact') THEN 'include' WHEN match_type = 'lexical_multi_token' THEN CASE WHEN match_confidence = 'high' THEN 'include' ELSE 'optional' END ELSE 'exclude' END AS recommendation FROM resolved""",
    "acc": """SELECT job_id, raw, skill_query, importance, category, canonical_skill, match_score, match_confidence, match_type, recommendation, min(seq) AS seq FROM req JOIN rec ON query = skill_query GROUP BY ALL""",
    "expanded": """WITH built AS (SELECT src_key AS person_id, dst_key AS project_id FROM edges WHERE type = 'BUILT'),
        school AS (SELECT src_key AS project_id, institution AS education FROM edges JOIN education ON education_id = dst_key WHERE type = 'PART_OF')
        SELECT DISTINCT person_id, e.dst_key AS canonical_skill, e.src_key AS source, 'Achievement' AS source_type, e.type AS relationship, name AS project, NULL::VARCHAR AS role, education
          FROM edges e JOIN edges a ON a.type = 'ACHIEVED' AND a.dst_key = e.src_key JOIN project p ON p.project_id = a.src_key JOIN built b ON b.project_id = a.src_key LEFT JOIN school s ON s.project_id = a.src_key WHERE e.type = 'DEMONSTRATES'
        UNION SELECT person_id, e.dst_key, name, 'Project', e.type, name, NULL, education FROM edges e JOIN project p ON p.project_id = e.src_key JOIN built b ON b.project_id = e.src_key LEFT JOIN school s ON s.project_id = e.src_key WHERE e.type = 'USED'
        UNION SELECT t.src_key, e.dst_key, institution, 'Education', e.type, NULL, NULL, NULL FROM edges e JOIN education d ON d.education_id = e.src_key JOIN edges t ON t.type = 'STUDIED_AT' AND t.dst_key = e.src_key WHERE e.type = 'LEARNED'""",
    "path": """SELECT b.src_key AS person_id, p.name AS pname, r.title FROM edges b JOIN edges d ON d.type = 'DURING' AND d.src_key = b.dst_key JOIN edges a ON a.type = 'AT' AND a.src_key = d.dst_key
        JOIN project p ON p.project_id = b.dst_key JOIN role r ON r.role_id = d.dst_key WHERE b.type = 'BUILT'""",
    "context": "SELECT person_id, 'project' AS kind, pname AS name FROM path UNION SELECT person_id, 'role', title FROM path",
    "ev": f"""SELECT *, CASE WHEN s >= 4 THEN 'strong' WHEN s >= 2 THEN 'moderate' ELSE 'weak' END AS evidence_strength FROM (
        SELECT *, CASE source_type WHEN 'Achievement' THEN 2 WHEN 'Education' THEN -1 ELSE 1 END + CASE WHEN professional_context THEN 2 ELSE 0 END + CASE WHEN regexp_matches(source, '{METRIC}') THEN 1 ELSE 0 END AS s FROM (
        SELECT e.*, (EXISTS (FROM context c WHERE c.person_id = e.person_id AND c.kind = 'project' AND c.name = e.project) OR EXISTS (FROM context c WHERE c.person_id = e.person_id AND c.kind = 'role' AND c.name = e.role)) AS professional_context FROM expanded e))""",
    "evn": f"SELECT person_id, canonical_skill, count(*) AS n_evidence, min({STRENGTH_RANK}) AS best, list_sort(list(DISTINCT coalesce(project, role, source))) AS sources FROM ev GROUP BY ALL",
    "status": f"""SELECT a.*, person_id, coalesce(n_evidence, 0) AS n_evidence, sources, {STRENGTH_OF.format('best')} AS strongest,
        CASE WHEN n_evidence IS NULL THEN 'gap' WHEN match_confidence = 'high' THEN 'matched' WHEN match_confidence = 'low' THEN 'partial' END AS bucket,
        CASE WHEN n_evidence IS NULL THEN CASE WHEN canonical_skill IS NULL THEN 'no matching skill in graph' ELSE 'skill exists but no evidence recorded' END END AS gap_reason
        FROM app JOIN acc a USING (job_id) LEFT JOIN evn USING (person_id, canonical_skill)""",
    "trans": """SELECT a.job_id, a.seq, 0 AS place, cap AS capability_query, 'named next' AS reason, 'llm_semantic' AS source, r.canonical_skill AS capability_skill, r.match_type AS capability_match FROM acc a
        JOIN (SELECT job_id, skill_query, arg_max(coalesce(cap, ''), seq) AS cap FROM req GROUP BY ALL) l USING (job_id, skill_query) JOIN resolved r ON r.query = l.cap WHERE l.cap <> ''""",
    "numbered": f"""SELECT s.job_id, s.person_id, s.seq, s.raw, s.skill_query, s.importance, s.recommendation, s.bucket, e.*  EXCLUDE (person_id),
        row_number() OVER (PARTITION BY s.job_id, s.person_id ORDER BY CASE WHEN bucket = 'matched' THEN 0 ELSE 1 END, skill_query, seq, {SIX}) AS n FROM status s JOIN ev e USING (person_id, canonical_skill) WHERE bucket IN ('matched', 'partial')""",
    "keyed": """SELECT *, CASE WHEN project <> '' THEN 'Project' WHEN role <> '' THEN 'Role' ELSE source_type END AS story_type, coalesce(nullif(project, ''), nullif(role, ''), source) AS label FROM numbered WHERE recommendation <> 'exclude'""",
    "agg": f"""SELECT job_id, person_id, story_type, label, bool_or(professional_context) AS professional_context, list_sort(coalesce(list(DISTINCT canonical_skill) FILTER (source_type <> 'Achievement'), [])) AS direct_skills,
        coalesce(arg_max(source_type, n) FILTER (source_type <> 'Achievement'), story_type) AS source_type, {STRENGTH_OF.format(f'min({STRENGTH_RANK})')} AS evidence_strength, min(n) AS first_seen FROM keyed GROUP BY job_id, person_id, story_type, label""",
    "sach": f"""SELECT job_id, person_id, story_type, label, source AS description, list_sort(list(DISTINCT canonical_skill)) AS matched_skills, arg_min(evidence_strength, n) AS evidence_strength, min(n) AS first_seen,
        regexp_matches(source, '{METRIC}') AS has_metric FROM keyed WHERE source_type = 'Achievement' GROUP BY job_id, person_id, story_type, label, source""",
    "sreq": "SELECT job_id, person_id, story_type, label, raw, min(n) AS first_seen, arg_min(importance, n) AS importance FROM keyed GROUP BY ALL",
    "pdet": """SELECT b.src_key AS person_id, p.name, d.title AS role_title, d.company, p.type, NULL::VARCHAR AS domain, p.context, NULL::VARCHAR AS description, NULL::VARCHAR AS person_role,
        CASE WHEN d.title IS NOT NULL THEN coalesce(p.start_date, d.start_date) ELSE p.start_date END AS start_date, NULL::VARCHAR AS end_date, NULL::VARCHAR AS location, d.work_mode, s.education
        FROM edges b JOIN project p ON p.project_id = b.dst_key
        LEFT JOIN (SELECT e.src_key AS project_id, r.title, a.dst_key AS company, r.start_date, r.work_mode FROM edges e JOIN role r ON r.role_id = e.dst_key JOIN edges a ON a.type = 'AT' AND a.src_key = e.dst_key WHERE e.type = 'DURING') d USING (project_id)
        LEFT JOIN (SELECT src_key AS project_id, institution AS education FROM edges JOIN education ON education_id = dst_key WHERE type = 'PART_OF') s USING (project_id) WHERE b.type = 'BUILT'""",
    "rdet": """SELECT h.src_key AS person_id, r.title AS name, a.dst_key AS company, r.description, r.start_date, r.end_date, r.location, r.work_mode FROM edges h JOIN role r ON r.role_id = h.dst_key
        LEFT JOIN edges a ON a.type = 'AT' AND a.src_key = h.dst_key WHERE h.type = 'HAD_ROLE'""",
    "story": f"""WITH ach AS (SELECT job_id, person_id, story_type, label, list(description ORDER BY first_seen) AS achs, list(matched_skills ORDER BY first_seen) AS achskills, count(*) AS n_achievements, bool_or(has_metric) AS any_metric FROM sach GROUP BY ALL),
        rq AS (SELECT job_id, person_id, story_type, label, list(raw ORDER BY first_seen) AS supports, count(*) FILTER (importance = 'required') AS required_count FROM sreq GROUP BY ALL)
        SELECT a.*, CASE WHEN a.source_type = 'Project' THEN a.label END AS project, p.role_title, p.company, p.type, p.domain, p.context, coalesce(p.description, d.description) AS description, p.person_role, coalesce(p.start_date, d.start_date) AS start_date,
          p.end_date, p.location, p.work_mode, p.education, d.program, d.status, coalesce(n_achievements, 0) AS n_achievements, coalesce(achs, []) AS achs, coalesce(achskills, []) AS achskills, supports, required_count,
          row_number() OVER (PARTITION BY job_id, person_id ORDER BY CASE WHEN n_achievements > 0 THEN 0 ELSE CASE a.source_type WHEN 'Project' THEN 1 WHEN 'Role' THEN 2 WHEN 'Education' THEN 3 ELSE 9 END END, -len(supports),
            CASE WHEN required_count > 0 THEN 0 ELSE 1 END, {STRENGTH_RANK}, CASE WHEN any_metric THEN 0 ELSE 1 END, first_seen) AS rank
        FROM agg a LEFT JOIN ach USING (job_id, person_id, story_type, label) JOIN rq USING (job_id, person_id, story_type, label)
        LEFT JOIN pdet p ON p.person_id = a.person_id AND p.name = a.label AND a.source_type = 'Project' LEFT JOIN education d ON d.institution = a.label AND a.source_type = 'Education'""",
    "skills": "SELECT DISTINCT job_id, person_id, name, display_name, s.category FROM numbered JOIN skill s ON s.name = canonical_skill WHERE recommendation <> 'exclude'",
    "parts": """SELECT *, CASE WHEN home IS NOT NULL THEN 'education' WHEN professional_context THEN 'professional' ELSE 'independent' END AS class,
        CASE WHEN home IS NOT NULL THEN home WHEN professional_context THEN coalesce(nullif(company, ''), nullif(role_title, ''), label) ELSE label END AS group_key FROM (
        SELECT s.*, h.home FROM story s LEFT JOIN (SELECT DISTINCT job_id, person_id, label AS home FROM story WHERE source_type = 'Education') h
        ON h.job_id = s.job_id AND h.person_id = s.person_id AND h.home = CASE s.source_type WHEN 'Education' THEN s.label WHEN 'Role' THEN s.company WHEN 'Project' THEN s.education END)""",
    "scored": f"""SELECT job_id, person_id, class, group_key, round((base + 2 * len(supported))::DOUBLE, 2) AS score, supported FROM (
        SELECT job_id, person_id, class, group_key, 3 * sum(required_count) + 4 - min({STRENGTH_RANK}) + sum(n_achievements) + CASE WHEN bool_or(professional_context) THEN 2 ELSE 0 END AS base,
        list_sort(list_distinct(flatten(list(supports)))) AS supported FROM parts GROUP BY ALL)""",
    "langs": "SELECT job_id, person_id, list(name) AS languages FROM skills WHERE category = 'language' GROUP BY ALL",
    "achev": f"""SELECT job_id, person_id, class, group_key, label, rank, text, sk, metric, achievement_id FROM (SELECT *, unnest(achs) AS text, unnest(achskills) AS sk FROM parts)
        JOIN (SELECT description AS text, max(achievement_id) AS achievement_id, max(metric) AS metric FROM achievement GROUP BY 1) USING (text)""",
    "xp": f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY job_id, person_id, class, group_key ORDER BY CASE WHEN class = 'education' AND source_type = 'Education' THEN 0 ELSE 1 END, rank) AS k FROM parts),
        g AS (SELECT job_id, person_id, class, group_key, list_sort(list_distinct(flatten(list(direct_skills)))) AS skills, sum(n_achievements)::BIGINT AS n_achievements, list_sort(coalesce(list(DISTINCT project) FILTER (project IS NOT NULL), [])) AS projects,
          min(rank) AS first_rank FROM parts GROUP BY ALL),
        m AS (SELECT job_id, person_id, class, group_key, list_sort(coalesce(list(DISTINCT metric) FILTER (metric <> ''), [])) AS metrics FROM achev GROUP BY ALL)
        SELECT g.*, {_slug('group_key')} AS experience_id, CASE WHEN class = 'independent' THEN CASE WHEN o.type LIKE '%volunteer%' THEN 'volunteer' ELSE 'independent_project' END ELSE class END AS experience_type,
          CASE WHEN class = 'professional' THEN coalesce(nullif(o.role_title, ''), o.label) ELSE group_key END AS title, CASE WHEN class = 'professional' THEN group_key END AS organization,
          CASE WHEN class = 'education' THEN o.program END AS program, CASE WHEN class = 'education' THEN o.status END AS status, CASE WHEN class = 'independent' THEN o.person_role END AS person_role, CASE WHEN class <> 'education' THEN o.location END AS location,
          CASE WHEN class <> 'education' THEN o.work_mode END AS work_mode, o.start_date, o.end_date, coalesce(m.metrics, []) AS metrics, score, supported,
          list_sort(list_filter(g.skills, lambda x: split_part(x, ' ', -1) IN ('ring', 'widget', 'bolt', 'gear'))) AS technologies,
          (class = 'independent' AND g.n_achievements = 0 AND len(list_filter(g.skills, lambda x: NOT list_contains(coalesce(languages, []), x))) = 0) AS lang_only
        FROM g JOIN o USING (job_id, person_id, class, group_key) JOIN scored USING (job_id, person_id, class, group_key) LEFT JOIN m USING (job_id, person_id, class, group_key) LEFT JOIN langs USING (job_id, person_id) WHERE k = 1""",
    "x": """SELECT *, CASE WHEN NOT lang_only AND score >= 5 THEN 'include' ELSE 'optional' END AS recommendation, CASE WHEN lang_only THEN 'Only language-skill evidence found -- relevant only if the role values that language.'
        WHEN score >= 5 THEN 'Strong, relevant matched evidence for this job description.' ELSE 'Some relevant evidence, but limited in strength or breadth.' END AS reason FROM xp""",
    "zr": f"""SELECT job_id, person_id, group_key, {_slug('group_key')} AS experience_id, CASE WHEN vol THEN 'volunteer' ELSE 'professional' END AS experience_type, CASE WHEN n = 1 THEN t[1] ELSE t[1] || ' (+' || (n - 1) || ' more role(s))' END AS title,
        company AS organization, start_date, NULL::VARCHAR AS end_date, list_sort(list_distinct(t)) AS titles, 0.0::DOUBLE AS score, 'omit' AS recommendation, 'No matched evidence found for the current job description.' AS reason FROM (
        SELECT job_id, person_id, coalesce(nullif(company, ''), title) AS group_key, count(*) AS n, list(title ORDER BY title, role_id) AS t, first(company ORDER BY title, role_id) AS company, first(start_date ORDER BY title, role_id) AS start_date,
          bool_or(coalesce(employment_type, '') = 'volunteer') AS vol
        FROM (SELECT app.*, r.role_id, r.title, r.employment_type, r.start_date, a.dst_key AS company FROM app JOIN edges h ON h.type = 'HAD_ROLE' AND h.src_key = person_id JOIN role r ON r.role_id = h.dst_key LEFT JOIN edges a ON a.type = 'AT' AND a.src_key = r.role_id) z
        WHERE NOT EXISTS (FROM parts p WHERE p.job_id = z.job_id AND p.person_id = z.person_id AND p.source_type = 'Education' AND p.label = z.company)
          AND NOT EXISTS (FROM xp WHERE xp.job_id = z.job_id AND xp.person_id = z.person_id AND (xp.organization = z.company OR xp.title = z.title)) GROUP BY ALL)""",
    "zp": f"""SELECT job_id, person_id, name AS group_key, {_slug('name')} AS experience_id, 'independent_project' AS experience_type, name AS title, 0.0::DOUBLE AS score, 'omit' AS recommendation, 'No matched evidence found for the current job description.' AS reason
        FROM (SELECT DISTINCT app.*, p.name FROM app JOIN edges b ON b.type = 'BUILT' AND b.src_key = person_id JOIN project p ON p.project_id = b.dst_key WHERE NOT EXISTS (FROM edges q WHERE q.type IN ('PART_OF', 'DURING') AND q.src_key = b.dst_key)) z
        WHERE NOT EXISTS (FROM xp WHERE xp.job_id = z.job_id AND xp.person_id = z.person_id AND xp.title = z.name)""",
    "reg": """SELECT job_id, person_id, name, arg_max(experience_id, o) AS experience_id FROM (SELECT *, row_number() OVER (PARTITION BY job_id, person_id, name ORDER BY step, place, group_key) AS o FROM (
        SELECT job_id, person_id, unnest(list_distinct(list_concat([group_key, title], projects, roles))) AS name, experience_id, CASE class WHEN 'professional' THEN 1 WHEN 'independent' THEN 2 ELSE 3 END AS step, first_rank AS place, group_key
          FROM (SELECT * EXCLUDE (projects), CASE WHEN class = 'independent' THEN [] ELSE projects END AS projects, []::VARCHAR[] AS roles FROM xp)
        UNION ALL SELECT job_id, person_id, unnest(list_distinct(list_concat([organization], titles))), experience_id, 4, 0, group_key FROM zr UNION ALL SELECT job_id, person_id, title, experience_id, 5, 0, group_key FROM zp) WHERE name <> '') GROUP BY ALL""",
    "regs": "SELECT job_id, person_id, map_from_entries(list((name, experience_id))) AS m FROM reg GROUP BY ALL",
    "located": """SELECT a.job_id, e.*, coalesce(map_extract(m, e.project)[1], map_extract(m, e.role)[1], map_extract(m, e.education)[1], CASE WHEN e.source_type = 'Education' THEN map_extract(m, e.source)[1] END) AS experience
        FROM app a JOIN ev e USING (person_id) LEFT JOIN regs r ON r.job_id = a.job_id AND r.person_id = a.person_id""",
    "routed": """SELECT *, CASE WHEN home IS NOT NULL THEN 'education' WHEN professional_context THEN 'experience' WHEN substantial THEN 'project' END AS section FROM (
        SELECT p.*, (n_achievements > 0 OR len(list_filter(direct_skills, lambda x: NOT list_contains(coalesce(languages, []), x))) > 0) AS substantial FROM parts p LEFT JOIN langs USING (job_id, person_id))""",
    "bul": """SELECT * EXCLUDE (fb), CASE WHEN n_achievements > 0 THEN list_transform(achs[1:4], lambda a: a || ' [' || a || ']') WHEN fb IS NOT NULL THEN [fb || ' [story:' || label || ']'] ELSE [] END AS bullets FROM (
        SELECT *, coalesce(nullif(description, ''), CASE WHEN len(direct_skills) > 0 THEN CASE WHEN source_type = 'Role' THEN 'Served as ' ELSE 'Contributed to ' END || label || ', applying ' ||
        array_to_string(CASE WHEN section = 'experience' THEN list_sort(direct_skills) ELSE list_sort(list_transform(direct_skills, lambda x: upper(x))) END, ', ') || '.' END) AS fb FROM routed)""",
    "edu_entries": f"""SELECT job_id, person_id, r AS rank, home AS title, NULL::VARCHAR AS organization, program AS location, {_date('sd')} AS start_date, {_date('ed')} AS end_date, b[1:4] AS bullets FROM (
        SELECT job_id, person_id, home, first(rank ORDER BY k) AS r, first(program ORDER BY k) AS program, first(start_date ORDER BY k) AS sd, first(end_date ORDER BY k) AS ed, flatten(list(CASE WHEN k = 1 THEN CASE WHEN description <> '' THEN [description || ' [education:' || home || ']'] ELSE [] END ELSE bullets END ORDER BY k)) AS b
        FROM (SELECT *, row_number() OVER (PARTITION BY job_id, person_id, home ORDER BY CASE WHEN source_type = 'Education' THEN 0 ELSE 1 END, rank) AS k FROM bul WHERE section = 'education') GROUP BY ALL)""",
    "exp_entries": f"SELECT job_id, person_id, rank, coalesce(nullif(role_title, ''), label) AS title, company AS organization, coalesce(nullif(location, ''), work_mode) AS location, {_date('start_date')} AS start_date, {_date('end_date')} AS end_date, bullets FROM bul WHERE section = 'experience'",
    "pro_entries": f"SELECT job_id, person_id, rank, label AS title, person_role AS organization, context AS location, {_date('start_date')} AS start_date, {_date('end_date')} AS end_date, bullets FROM bul WHERE section = 'project'",
    "bucketed": """SELECT job_id, person_id, CASE category WHEN 'technical' THEN 'programming' WHEN 'tool' THEN 'tools' ELSE 'capabilities' END AS bucket, list_sort(list(display_name)) AS names FROM skills WHERE category <> 'language' GROUP BY ALL""",
    "tech": """SELECT job_id, person_id, list(display_name ORDER BY k) AS tech FROM (SELECT *, row_number() OVER (PARTITION BY job_id, person_id ORDER BY s, rank, i) AS k FROM (
        SELECT job_id, person_id, display_name, s, rank, i, row_number() OVER (PARTITION BY job_id, person_id, display_name ORDER BY s, rank, i) AS d FROM (
        SELECT job_id, person_id, CASE WHEN section = 'experience' THEN 0 ELSE 1 END AS s, rank, unnest(direct_skills) AS name, generate_subscripts(direct_skills, 1) AS i FROM routed WHERE section IN ('experience', 'project'))
        JOIN skills USING (job_id, person_id, name) WHERE category IN ('technical', 'tool')) WHERE d = 1) WHERE k <= 6 GROUP BY ALL""",
    "techt": "SELECT *, CASE WHEN len(tech) = 1 THEN tech[1] ELSE array_to_string(tech[1:len(tech) - 1], ', ') || ' and ' || tech[len(tech)] END AS tech_text FROM tech",
    "prof": """SELECT job_id, person_id, 'Software Engineer' AS headline, coalesce('Software engineer with hands-on experience building full-stack applications and AI-assisted tooling using ' || tech_text || '.', 'Software engineer with hands-on, project-based engineering experience.')
        || CASE WHEN e OR p THEN ' Experience gained through ' || concat_ws(', ', CASE WHEN e THEN 'professional engineering work' END, CASE WHEN p THEN 'independent full-stack projects' END) || '.' ELSE '' END AS profile
        FROM app LEFT JOIN (SELECT job_id, person_id, bool_or(coalesce(section = 'experience', false)) AS e, bool_or(coalesce(section = 'project', false)) AS p FROM routed GROUP BY ALL) USING (job_id, person_id) LEFT JOIN techt USING (job_id, person_id)""",
    "lined": """SELECT job_id, person_id, section, rank, title, array_to_string(list_concat(['### ' || title || coalesce(' — ' || nullif(organization, ''), '')], CASE WHEN meta <> '' THEN ['*' || meta || '*'] ELSE [] END, [''],
          list_transform(bullets, lambda b: '- ' || regexp_replace(b, ' \\[[^\\]]*\\]$', '')), ['']), chr(10)) AS block FROM (
        SELECT *, concat_ws(' | ', nullif(location, ''), CASE WHEN start_date <> '' THEN start_date || ' – ' || coalesce(nullif(end_date, ''), 'Present') END) AS meta FROM (
        SELECT *, 'experience' AS section FROM exp_entries UNION ALL SELECT *, 'project' FROM pro_entries UNION ALL SELECT *, 'education' FROM edu_entries))""",
    "bodies": "SELECT job_id, person_id, section, string_agg(block, chr(10) ORDER BY rank, title) AS body FROM lined GROUP BY ALL",
    "rendered": r"""SELECT job_id, person_id, regexp_replace(concat_ws(chr(10), '# ' || c_name || chr(10), '### ' || headline || chr(10), profile || chr(10), '## Experience' || chr(10) || e.body, '## Projects' || chr(10) || p.body, '## Education' || chr(10) || d.body,
          '## Technical Skills' || chr(10) || nullif(t, '') || chr(10), '## Languages' || chr(10) || l || chr(10)), '^\s+|\s+$', '', 'g') || chr(10) AS text
        FROM prof JOIN customer ON c_custkey::VARCHAR = person_id LEFT JOIN (FROM bodies WHERE section = 'experience') e USING (job_id, person_id) LEFT JOIN (FROM bodies WHERE section = 'project') p USING (job_id, person_id)
        LEFT JOIN (FROM bodies WHERE section = 'education') d USING (job_id, person_id)
        LEFT JOIN (SELECT job_id, person_id, string_agg('**' || CASE bucket WHEN 'programming' THEN 'Languages' WHEN 'tools' THEN 'Tools' ELSE 'Capabilities' END || ':** ' || array_to_string(names, ', '), chr(10)
          ORDER BY list_position(['programming', 'tools', 'capabilities'], bucket)) AS t FROM bucketed GROUP BY ALL) USING (job_id, person_id)
        LEFT JOIN (SELECT job_id, person_id, array_to_string(list_sort(list(display_name)), ', ') AS l FROM skills WHERE category = 'language' GROUP BY ALL) USING (job_id, person_id)""",
    "evlist": f"""SELECT person_id, canonical_skill, list({{'source': source, 'sourceType': source_type, 'relationship': relationship, 'project': project, 'role': role, 'education': education, 'professionalContext': professional_context, 'evidenceStrength': evidence_strength}} ORDER BY {SIX}) AS evidence FROM ev GROUP BY ALL""",
    "reqsum": f"""WITH refs AS (SELECT job_id, person_id, canonical_skill, list({{'experience': experience, 'sourceType': source_type, 'evidenceStrength': evidence_strength, 'professionalContext': professional_context}} ORDER BY {SIX}) AS evidence FROM located GROUP BY ALL),
        given AS (SELECT s.job_id, s.person_id, s.seq, list({{'capability': coalesce(capability_skill, capability_query), 'experience': evidence[1].experience, 'reason': reason, 'evidenceStrength': evidence[1].evidenceStrength}} ORDER BY place) AS given
          FROM status s JOIN trans t USING (job_id, seq) LEFT JOIN refs r ON r.job_id = s.job_id AND r.person_id = s.person_id AND r.canonical_skill = t.capability_skill GROUP BY ALL)
        SELECT job_id, person_id, seq, bucket, {{'requirement': raw, 'skillQuery': skill_query, 'importance': importance, 'category': category, 'matchType': match_type, 'matchConfidence': match_confidence, 'recommendation': recommendation, 'literalStatus': bucket,
          'evidence': coalesce(evidence, []), 'transferableEvidence': coalesce(given, [])}} AS doc FROM status LEFT JOIN refs USING (job_id, person_id, canonical_skill) LEFT JOIN given USING (job_id, person_id, seq)""",
    "buckets": "SELECT job_id, person_id, list(doc ORDER BY seq) FILTER (bucket = 'matched') AS matched, list(doc ORDER BY seq) FILTER (bucket = 'partial') AS partial, list(doc ORDER BY seq) FILTER (bucket = 'gap') AS gaps FROM reqsum GROUP BY ALL",
    "context_docs": f"""WITH given AS (SELECT s.job_id, s.person_id, s.seq, list({{'capabilityQuery': capability_query, 'canonicalSkill': capability_skill, 'matchType': capability_match, 'reason': reason, 'source': source, 'evidence': coalesce(evidence, [])}} ORDER BY place) AS given
          FROM status s JOIN trans t USING (job_id, seq) LEFT JOIN evlist v ON v.person_id = s.person_id AND v.canonical_skill = t.capability_skill GROUP BY ALL),
        m AS (SELECT job_id, person_id, seq, bucket, {{'requirement': raw, 'skillQuery': skill_query, 'importance': importance, 'category': category, 'matchType': match_type, 'canonicalSkill': canonical_skill, 'confidence': match_confidence, 'recommendation': recommendation,
          'evidence': coalesce(evidence, []), 'transferableEvidence': coalesce(given, [])}} AS doc FROM status LEFT JOIN evlist USING (person_id, canonical_skill) LEFT JOIN given USING (job_id, person_id, seq)),
        mb AS (SELECT job_id, person_id, list(doc ORDER BY seq) FILTER (bucket = 'matched') AS matched, list(doc ORDER BY seq) FILTER (bucket = 'partial') AS partial, list(doc ORDER BY seq) FILTER (bucket = 'gap') AS gaps FROM m GROUP BY ALL),
        asked AS (SELECT job_id, list({{'raw': raw, 'skillQuery': skill_query, 'importance': importance, 'category': category, 'relatedCapabilities': CASE WHEN cap IS NULL THEN [] ELSE [{{'skillQuery': cap, 'reason': 'named next', 'source': 'llm_semantic'}}] END}} ORDER BY seq) AS requirements FROM req GROUP BY ALL),
        told AS (SELECT job_id, person_id, story_type, label, list({{'description': description, 'matchedSkills': matched_skills, 'evidenceStrength': evidence_strength, 'hasMetric': has_metric}} ORDER BY first_seen) AS told FROM sach GROUP BY ALL),
        st AS (SELECT job_id, person_id, list({{'label': label, 'sourceType': source_type, 'project': project, 'roleTitle': role_title, 'company': company, 'type': type, 'domain': domain, 'context': context, 'description': description, 'personRole': person_role, 'startDate': start_date, 'endDate': end_date,
          'location': location, 'workMode': work_mode, 'education': education, 'program': program, 'status': status, 'professionalContext': professional_context, 'evidenceStrength': evidence_strength, 'directSkills': direct_skills, 'strongestAchievements': coalesce(told, []),
          'supportsRequirements': supports, 'requiredCount': required_count}} ORDER BY rank) AS stories FROM story LEFT JOIN told USING (job_id, person_id, story_type, label) GROUP BY ALL),
        sk AS (SELECT job_id, person_id, list({{'name': name, 'displayName': display_name, 'category': category}} ORDER BY name) AS skills FROM skills GROUP BY ALL)
        SELECT job_id, person_id, {{'requirements': coalesce(requirements, []), 'matchedRequirements': coalesce(matched, []), 'partialRequirements': coalesce(partial, []), 'gaps': coalesce(gaps, []), 'evidenceStories': coalesce(stories, []), 'skills': coalesce(sk.skills, []),
          'cvGuidance': {{'targetingPrinciples': ['Lead with evidence for what the job requires.', 'A gap stays a gap, whatever related evidence there is.']}}}} AS doc
        FROM app LEFT JOIN asked USING (job_id) LEFT JOIN mb USING (job_id, person_id) LEFT JOIN st USING (job_id, person_id) LEFT JOIN sk USING (job_id, person_id)""",
    "structured_docs": r"""WITH b AS (SELECT *, list_transform(bullets, lambda x: {'text': regexp_replace(x, ' \[[^\]]*\]$', ''), 'evidenceIds': [regexp_extract(x, ' \[([^\]]*)\]$', 1)]}) AS shown FROM (SELECT *, 'experience' AS section FROM exp_entries UNION ALL SELECT *, 'project' FROM pro_entries UNION ALL SELECT *, 'education' FROM edu_entries)),
        e AS (SELECT job_id, person_id, list({'title': title, 'organization': organization, 'location': location, 'startDate': start_date, 'endDate': end_date, 'bullets': shown} ORDER BY rank, title) FILTER (section = 'experience') AS experience,
          list({'name': title, 'role': organization, 'context': location, 'startDate': start_date, 'endDate': end_date, 'bullets': shown} ORDER BY rank, title) FILTER (section = 'project') AS projects,
          list({'institution': title, 'program': location, 'startDate': start_date, 'endDate': end_date, 'bullets': shown} ORDER BY rank, title) FILTER (section = 'education') AS education FROM b GROUP BY ALL),
        s AS (SELECT job_id, person_id, any_value(names) FILTER (bucket = 'programming') AS programming, any_value(names) FILTER (bucket = 'tools') AS tools, any_value(names) FILTER (bucket = 'capabilities') AS capabilities FROM bucketed GROUP BY ALL),
        l AS (SELECT job_id, person_id, list(display_name ORDER BY display_name) AS languages FROM skills WHERE category = 'language' GROUP BY ALL)
        SELECT job_id, person_id, {'name': c_name, 'headline': headline, 'profile': profile, 'experience': coalesce(experience, []), 'projects': coalesce(projects, []), 'education': coalesce(education, []),
          'skills': {'programming': coalesce(programming, []), 'frameworks': []::VARCHAR[], 'databases': []::VARCHAR[], 'tools': coalesce(tools, []), 'capabilities': coalesce(capabilities, [])}, 'languages': coalesce(languages, [])} AS doc
        FROM prof JOIN customer ON c_custkey::VARCHAR = person_id LEFT JOIN e USING (job_id, person_id) LEFT JOIN s USING (job_id, person_id) LEFT JOIN l USING (job_id, person_id)""",
    "translist": f"""WITH f AS (SELECT job_id, person_id, canonical_skill AS capability_skill, first(experience ORDER BY {SIX}) AS experience FROM located GROUP BY ALL)
        SELECT job_id, person_id, seq, raw, bucket, CASE bucket WHEN 'gap' THEN 1 WHEN 'partial' THEN 2 WHEN 'matched' THEN 3 ELSE 0 END AS status_order, place, coalesce(capability_skill, capability_query) AS capability, experience, reason
        FROM status JOIN trans USING (job_id, seq) LEFT JOIN f USING (job_id, person_id, capability_skill)""",
    "package_docs": f"""WITH origin AS (SELECT job_id, person_id, class, group_key, list({{'sourceType': source_type, 'project': CASE WHEN NOT (class = 'education' AND source_type = 'Education') THEN project END, 'role': CASE WHEN class = 'education' THEN CASE WHEN source_type = 'Role' THEN label END ELSE role_title END,
          'company': CASE WHEN class = 'professional' OR (class = 'education' AND source_type = 'Role') THEN company END, 'education': CASE WHEN class = 'education' THEN home END,
          'relationship': CASE WHEN class = 'professional' AND project IS NOT NULL THEN 'DURING' WHEN class = 'education' AND source_type = 'Project' THEN 'PART_OF' END}} ORDER BY rank) AS origins FROM parts GROUP BY ALL),
        fnd AS (SELECT job_id, person_id, class, group_key, list({{'achievementId': achievement_id, 'text': text, 'metric': metric, 'hasMetric': regexp_matches(text, '{METRIC}') OR metric IS NOT NULL, 'skills': sk}} ORDER BY rank, text) AS achs FROM achev GROUP BY ALL),
        homes AS (SELECT DISTINCT job_id, person_id, class, group_key FROM parts WHERE class = 'education'),
        mine AS (SELECT DISTINCT b.src_key AS person_id, institution AS group_key, name FROM edges b JOIN edges p ON p.type = 'PART_OF' AND p.src_key = b.dst_key JOIN project ON project_id = b.dst_key JOIN education ON education_id = p.dst_key WHERE b.type = 'BUILT'),
        unused AS (SELECT h.*, list(name ORDER BY name) AS unused FROM homes h JOIN mine USING (person_id, group_key) WHERE NOT EXISTS (FROM parts u WHERE u.class = 'education' AND u.source_type = 'Project' AND u.job_id = h.job_id AND u.person_id = h.person_id AND u.group_key = h.group_key AND u.project = mine.name) GROUP BY ALL),
        ex AS (SELECT job_id, person_id, list_position(['professional', 'independent', 'education'], class) AS kind, first_rank AS place, group_key, {{'experienceId': experience_id, 'experienceType': experience_type, 'title': title, 'personRole': person_role, 'organization': organization,
          'institution': CASE WHEN class = 'education' THEN group_key END, 'program': program, 'status': status, 'location': location, 'startDate': start_date, 'endDate': end_date, 'workMode': work_mode, 'projects': CASE WHEN class = 'independent' THEN [] ELSE projects END, 'roles': []::VARCHAR[],
          'referenceProjects': coalesce(unused, []), 'relevance': {{'score': score, 'supportedRequirements': supported}}, 'skills': skills, 'technologies': technologies, 'achievements': coalesce(achs, []), 'metrics': metrics, 'provenance': coalesce(origins, []), 'recommendation': recommendation,
          'recommendationReason': reason}} AS d FROM x LEFT JOIN origin USING (job_id, person_id, class, group_key) LEFT JOIN fnd USING (job_id, person_id, class, group_key) LEFT JOIN unused USING (job_id, person_id, class, group_key)),
        zero AS (SELECT job_id, person_id, 4 AS kind, group_key, experience_id, experience_type, title, organization, start_date, reason FROM zr UNION ALL SELECT job_id, person_id, 5, group_key, experience_id, experience_type, title, NULL, NULL, reason FROM zp),
        none AS (SELECT job_id, person_id, kind, 0 AS place, group_key, {{'experienceId': experience_id, 'experienceType': experience_type, 'title': title, 'personRole': NULL::VARCHAR, 'organization': organization, 'institution': NULL::VARCHAR, 'program': NULL::VARCHAR, 'status': NULL::VARCHAR, 'location': NULL::VARCHAR,
          'startDate': start_date, 'endDate': NULL::VARCHAR, 'workMode': NULL::VARCHAR, 'projects': []::VARCHAR[], 'roles': []::VARCHAR[], 'referenceProjects': []::VARCHAR[], 'relevance': {{'score': 0.0::DOUBLE, 'supportedRequirements': []::VARCHAR[]}}, 'skills': []::VARCHAR[], 'technologies': []::VARCHAR[],
          'achievements': [], 'metrics': []::VARCHAR[], 'provenance': [], 'recommendation': 'omit', 'recommendationReason': reason}} AS d FROM zero),
        exs AS (SELECT job_id, person_id, list(j ORDER BY kind, place, group_key) AS experiences FROM (SELECT job_id, person_id, kind, place, group_key, to_json(d) AS j FROM ex UNION ALL SELECT job_id, person_id, kind, place, group_key, to_json(d) FROM none) GROUP BY ALL),
        ord AS (SELECT job_id, person_id, list(experience_id ORDER BY score DESC, CASE WHEN experience_type = 'professional' THEN 0 ELSE 1 END, CASE class WHEN 'professional' THEN 1 WHEN 'independent' THEN 2 ELSE 3 END, first_rank) AS ids FROM x GROUP BY ALL),
        giv AS (SELECT job_id, person_id, list({{'requirement': raw, 'literalStatus': bucket, 'capability': capability, 'experience': experience, 'reason': reason}} ORDER BY status_order, seq, place) AS given FROM translist GROUP BY ALL),
        lit AS (SELECT DISTINCT job_id, person_id, canonical_skill AS name FROM status WHERE bucket IN ('matched', 'partial')), oth AS (SELECT DISTINCT job_id, person_id, capability_skill AS name FROM status JOIN trans USING (job_id, seq) EXCEPT SELECT * FROM lit),
        rel AS (SELECT job_id, person_id, list({{'name': name, 'displayName': display_name, 'category': category, 'relevance': relevance}} ORDER BY relevance, name) AS relevant FROM skills JOIN (SELECT *, 'literal' AS relevance FROM lit UNION ALL SELECT *, 'transferable' FROM oth) USING (job_id, person_id, name) WHERE category <> 'language' GROUP BY ALL),
        shw AS (SELECT job_id, person_id, name, list_sort(list(DISTINCT label)) AS labels FROM (SELECT job_id, person_id, label, unnest(direct_skills) AS name FROM story) GROUP BY ALL),
        lan AS (SELECT job_id, person_id, list({{'name': display_name, 'proficiency': NULL::VARCHAR, 'evidence': coalesce(labels, [])}} ORDER BY name) AS languages FROM skills LEFT JOIN shw USING (job_id, person_id, name) WHERE category = 'language' GROUP BY ALL),
        thn AS (SELECT DISTINCT job_id, person_id, canonical_skill AS name FROM status WHERE bucket IN ('matched', 'partial') UNION SELECT job_id, person_id, name FROM skills WHERE category <> 'language'), tho AS (SELECT job_id, person_id, split_part(name, ' ', -1) AS noun, count(*) AS overlap FROM thn GROUP BY ALL),
        thp AS (SELECT *, row_number() OVER (PARTITION BY job_id, person_id ORDER BY overlap DESC, list_position(['ring','bolt','plate','rod','gear','gizmo','anvil','widget'], noun)) AS place FROM tho), thm AS (SELECT job_id, person_id, list('theme ' || noun ORDER BY place) AS themes FROM thp WHERE place <= 5 GROUP BY ALL)
        SELECT job_id, person_id, {{'experiences': coalesce(experiences, []), 'recommendedExperienceOrder': coalesce(ids, []), 'requirements': {{{_lists('matched', 'partial', 'gaps')}}}, 'transferableEvidence': coalesce(given, []), 'relevantSkills': coalesce(relevant, []), 'languages': coalesce(lan.languages, []),
          'strongestThemes': coalesce(themes, [])}} AS doc FROM app LEFT JOIN exs USING (job_id, person_id) LEFT JOIN ord USING (job_id, person_id) LEFT JOIN buckets USING (job_id, person_id) LEFT JOIN giv USING (job_id, person_id) LEFT JOIN rel USING (job_id, person_id)
          LEFT JOIN lan USING (job_id, person_id) LEFT JOIN thm USING (job_id, person_id)""",
    "sunk_lists": "SELECT 'requirements' AS kind, job_id, NULL::VARCHAR AS person_id, list({'raw': raw, 'skillQuery': skill_query, 'importance': importance, 'category': category} ORDER BY seq) AS doc FROM req GROUP BY job_id",
    "wskill": rf"""SELECT name, upper(name) AS display_name, list_sort(list(DISTINCT alias)) AS aliases, CASE WHEN length(name) % 2 = 0 THEN 'tool' ELSE 'capability' END AS category FROM (
        SELECT array_to_string(w[1:2], ' ') AS name, array_to_string(w[3:4], ' ') AS alias FROM (SELECT regexp_split_to_array(lower(text), '\s+') AS w FROM benchmark)) WHERE len({_terms('name')}) > 0 GROUP BY 1""",
    "cands": "SELECT name AS skill, category, unnest(list_concat([name], aliases)) AS c, generate_subscripts(list_concat([name], aliases), 1) AS place FROM wskill",
    "kw": r"""SELECT job_id, skill, category, arg_min(pos, place) AS pos, arg_min(length(c), place) AS ln, any_value(text) AS text FROM (
        SELECT doc_id::VARCHAR AS job_id, skill, k.category, c, place, text, length(regexp_extract(lower(text), '(?s)^(.*?)(^|[^a-z0-9])' || regexp_escape(c) || '([^a-z0-9]|$)', 1)) + length(regexp_extract(lower(text), '(?s)^(.*?)(^|[^a-z0-9])' || regexp_escape(c) || '([^a-z0-9]|$)', 2)) + 1 AS pos
        FROM documents JOIN cands k ON c <> '' AND contains(lower(text), c) WHERE regexp_matches(lower(text), '(^|[^a-z0-9])' || regexp_escape(c) || '([^a-z0-9]|$)')) GROUP BY ALL""",
    "same": r"""SELECT item_id, doc_id FROM (SELECT item_id, left(trim(regexp_replace(text, '\s+', ' ', 'g')), 200) AS probe FROM benchmark) JOIN (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS body FROM documents) ON contains(body, probe) WHERE length(probe) > 40""",
}

JPX = "job_id, person_id"
KEY = "job_id, person_id, story_type, label"
GROUPX = "job_id, person_id, class, group_key"
PROPS = "role_title, company, type, domain, context, description, person_role, start_date, end_date, location, work_mode, education, program, status"
NB = "array_to_string(bullets, '|') AS bullets"
E0 = "experience_id, experience_type, title"

ORACLES: dict[str, str] = {
    "a01_read_graph": """SELECT DISTINCT 'node' AS kind, 'Person' AS name, o_custkey::VARCHAR AS key, NULL AS other FROM orders UNION ALL SELECT 'node', 'Project', o_orderkey::VARCHAR, o_orderpriority FROM orders
        UNION ALL SELECT 'edge', 'BUILT', o_custkey::VARCHAR, o_orderkey::VARCHAR FROM orders""",
    "a08_written_documents": """WITH lines AS (SELECT kind, job_id, md5(to_json({'job_id': job_id, 'person_id': person_id, 'doc': doc})::VARCHAR) AS line_md5 FROM sunk_lists
          UNION ALL SELECT 'context', job_id, md5(to_json({'job_id': job_id, 'person_id': person_id, 'doc': doc})::VARCHAR) FROM context_docs UNION ALL SELECT 'package', job_id, md5(to_json({'job_id': job_id, 'person_id': person_id, 'doc': doc})::VARCHAR) FROM package_docs
          UNION ALL SELECT 'document', job_id, md5(to_json({'job_id': job_id, 'person_id': person_id, 'doc': doc})::VARCHAR) FROM structured_docs)
        SELECT kind, job_id, line_md5, count(*) AS n FROM lines GROUP BY ALL UNION ALL SELECT kind, '(manifest)', NULL, count(*) FROM lines GROUP BY ALL""",
    "a09_staged_documents": """SELECT kind, job_id, person_id, md5(to_json(doc)::VARCHAR) AS doc_md5 FROM sunk_lists UNION ALL SELECT 'context', job_id, person_id, md5(to_json(doc)::VARCHAR) FROM context_docs
        UNION ALL SELECT 'package', job_id, person_id, md5(to_json(doc)::VARCHAR) FROM package_docs UNION ALL SELECT 'document', job_id, person_id, md5(to_json(doc)::VARCHAR) FROM structured_docs""",
    "a02_upsert_nodes": "SELECT 'Project' AS label, o_orderkey::VARCHAR AS key, 'Project ' || o_orderkey AS name, CASE WHEN o_orderstatus = 'F' THEN 'closed' END AS type, o_orderstatus AS status FROM orders",
    "a03_upsert_edges": "SELECT * FROM edges WHERE type = 'USED' UNION SELECT 'USED', 'Project', l_orderkey::VARCHAR, 'Skill', p_name FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag <> 'A'",
    "a04_rejected": "SELECT 'node' AS kind, 'Order' AS name, o_orderkey::VARCHAR AS key FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'edge', 'MADE', src_key || '>' || dst_key FROM edges WHERE type = 'BUILT'",
    "a05_duplicate_keys": "SELECT 'Achievement' AS label, l_orderkey || ':' || l_linenumber AS key, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "a06_valid_requirements": "SELECT seq::VARCHAR AS job_id, 0 AS seq, raw, skill_query, importance, category FROM req WHERE importance <> 'inferred' AND category <> 'domain'",
    "a06_rejected_lists": "SELECT seq::VARCHAR AS job_id FROM req WHERE importance = 'inferred' OR category = 'domain'",
    "a07_job_texts": r"""SELECT job_id, CASE WHEN octet_length(encode(text)) + bad > 5000 THEN 'too_large' WHEN bad = 1 THEN 'undecodable' WHEN regexp_replace(text, '\s+', '', 'g') = '' THEN 'blank' ELSE 'read' END AS status,
        CASE WHEN octet_length(encode(text)) <= 5000 AND bad = 0 AND regexp_replace(text, '\s+', '', 'g') <> '' THEN md5(text) END AS text_md5
        FROM (SELECT doc_id::VARCHAR AS job_id, CASE WHEN doc_id % 10 = 7 OR coalesce(text, '') = '' THEN ' ' || chr(9) ELSE text END AS text, CASE WHEN doc_id % 10 = 3 AND text <> '' THEN 1 ELSE 0 END AS bad FROM documents)""",
    "b01_summary": """WITH c AS (SELECT 'node' AS kind, label AS name, count(*) AS n FROM nodes GROUP BY ALL UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY ALL)
        SELECT * FROM c UNION ALL SELECT kind, '(all)', sum(n)::BIGINT FROM c GROUP BY ALL""",
    "b02_person_roles": """SELECT h.src_key AS person_id, role_id, title, a.dst_key AS company, start_date, row_number() OVER (PARTITION BY h.src_key ORDER BY coalesce(start_date, '0000'), role_id, coalesce(a.dst_key, '')) AS place
        FROM edges h JOIN role ON role_id = h.dst_key LEFT JOIN edges a ON a.type = 'AT' AND a.src_key = role_id WHERE h.type = 'HAD_ROLE'""",
    "b03_person_projects": "SELECT src_key AS person_id, project_id, name, row_number() OVER (PARTITION BY src_key ORDER BY name, project_id) AS place FROM edges JOIN project ON project_id = dst_key WHERE edges.type = 'BUILT'",
    "b04_person_education": "SELECT c_custkey::VARCHAR AS person_id, c_name AS name, education_id, institution, program FROM customer LEFT JOIN edges ON type = 'STUDIED_AT' AND src_key = c_custkey::VARCHAR LEFT JOIN education ON education_id = dst_key",
    "b05_curriculum_projects": "SELECT institution, name, row_number() OVER (PARTITION BY institution ORDER BY name) AS place FROM (SELECT DISTINCT institution, name FROM edges JOIN project ON project_id = src_key JOIN education ON education_id = dst_key WHERE edges.type = 'PART_OF')",
    "b06_nodes_of_label": "SELECT * FROM role",
    "b07_neighbours": "SELECT src_label AS label, src_key AS key, 'out' AS direction, type, dst_label AS other_label, dst_key AS other_key FROM edges UNION ALL SELECT dst_label, dst_key, 'in', type, src_label, src_key FROM edges",
    "b08_node_refs": "SELECT label || ':' || key AS ref FROM nodes",
    "b09_expansion": """WITH n AS (SELECT src_label AS label, src_key AS key, type, dst_label AS ol, dst_key AS ok FROM edges UNION ALL SELECT dst_label, dst_key, type, src_label, src_key FROM edges),
        h0 AS (SELECT 'Education' AS root_label, education_id AS root_key, 'Education' AS label, education_id AS key, 0 AS hop FROM education),
        h1 AS (SELECT DISTINCT root_label, root_key, ol AS label, ok AS key, 1 AS hop FROM (SELECT *, row_number() OVER (PARTITION BY root_label, root_key, label, key ORDER BY t, ol, ok) AS k FROM (SELECT root_label, root_key, label, key, ol, ok, min(type) AS t FROM h0 JOIN n USING (label, key)
          WHERE NOT EXISTS (FROM h0 s WHERE s.root_key = h0.root_key AND s.label = ol AND s.key = ok) GROUP BY ALL)) WHERE k <= 10),
        s1 AS (FROM h0 UNION ALL FROM h1),
        h2 AS (SELECT DISTINCT root_label, root_key, ol AS label, ok AS key, 2 AS hop FROM (SELECT *, row_number() OVER (PARTITION BY root_label, root_key, label, key ORDER BY t, ol, ok) AS k FROM (SELECT root_label, root_key, label, key, ol, ok, min(type) AS t FROM h1 JOIN n USING (label, key)
          WHERE NOT EXISTS (FROM s1 s WHERE s.root_key = h1.root_key AND s.label = ol AND s.key = ok) GROUP BY ALL)) WHERE k <= 10)
        SELECT * FROM s1 UNION ALL SELECT * FROM h2""",
    "b10_display_labels": "SELECT * FROM nodes",
    "b11_standalone_projects": "SELECT project_id, name FROM project WHERE NOT EXISTS (FROM edges WHERE type = 'PART_OF' AND src_key = project_id)",
    "b12_vocabulary": "SELECT name, display_name, category FROM skill WHERE category = 'tool'",
    "c01_tokens": f"""SELECT doc_id, coalesce(string_agg(t, ' ' ORDER BY i), '') AS tokens FROM (SELECT doc_id, t, min(i) AS i FROM (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, {_terms('text')} AS w FROM documents)) GROUP BY ALL) GROUP BY 1""",
    "c02_normalize": r"SELECT doc_id, md5(lower(regexp_replace(text, '^\s+|\s+$', '', 'g'))) AS text_md5 FROM documents",
    "c03_postings": "SELECT skill, field, dl::INT AS dl, term, tf FROM postings",
    "c04_candidates": "SELECT query, skill, score, rank FROM ranked WHERE rank <= 5 AND query IN (SELECT skill_query FROM req)",
    "c05_exact_class": "SELECT query, skill, exact AS exact_class FROM judged WHERE rank <= 5 AND query IN (SELECT skill_query FROM req)",
    "c06_overlap": "SELECT query, skill, array_to_string(overlap, ' ') AS overlap FROM judged WHERE rank <= 5 AND query IN (SELECT skill_query FROM req)",
    "c07_resolve": "SELECT * FROM resolved WHERE query IN (SELECT skill_query FROM req)",
    "c08_recommendation": "SELECT query, recommendation FROM rec WHERE query IN (SELECT skill_query FROM req)",
    "c09_resolve_requirements": "SELECT r.* EXCLUDE (query), job_id, seq, raw, skill_query, importance, category FROM req JOIN rec r ON query = skill_query",
    "c10_capabilities": "SELECT query, canonical_skill, match_score, match_confidence, match_type, 'preferred' AS importance, 'capability' AS category FROM resolved WHERE query IN (SELECT cap FROM req)",
    "c11_suggestions": """SELECT query, skill, score, place, array_to_string(overlap, '|') AS shared_terms FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank) AS place FROM judged WHERE rank <= 15 AND len(overlap) > 0 AND query IN (SELECT skill_query FROM req)) WHERE place <= 3""",
    "c12_autofill": """WITH s AS (SELECT query, string_agg(skill || ':graph_vocabulary', '|' ORDER BY place) AS r FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank) AS place FROM judged WHERE rank <= 15 AND len(overlap) > 0) WHERE place <= 3 AND skill <> query GROUP BY 1)
        SELECT job_id, seq, CASE WHEN cap IS NOT NULL THEN cap || ':llm_semantic' ELSE coalesce(r, '') END AS related FROM req LEFT JOIN s ON query = skill_query""",
    "c13_vocabulary_check": "SELECT query, match_type IN ('canonical_exact', 'alias_exact') AS exists, canonical_skill, display_name, category, match_type FROM resolved LEFT JOIN skill ON name = canonical_skill WHERE query IN (SELECT skill_query FROM req)",
    "c14_keyword_requirements": "SELECT job_id, skill AS skill_query, 'preferred' AS importance, CASE WHEN category IN ('technical', 'tool', 'language') THEN 'technology' ELSE 'capability' END AS category FROM kw",
    "c15_snippets": r"SELECT job_id, skill AS skill_query, coalesce(nullif(regexp_replace(substring(text, greatest(1, pos - 60), pos + ln + 60 - greatest(1, pos - 60)), '^\s+|\s+$', '', 'g'), ''), upper(skill)) AS raw FROM kw",
    "c16_requirement_category": "SELECT name, CASE WHEN category IN ('technical', 'tool', 'language') THEN 'technology' ELSE 'capability' END AS requirement_category FROM skill",
    "c17_same_document": "SELECT * FROM same",
    "c18_composition": """WITH h AS (SELECT doc_id::VARCHAR AS job_id, min(item_id) AS item_id FROM same GROUP BY 1) SELECT job_id, 'curated' AS skill_query, 'required' AS importance, 'domain' AS category, 'cached_manual' AS mode FROM h
        UNION ALL SELECT job_id, skill, 'preferred', CASE WHEN category IN ('technical', 'tool', 'language') THEN 'technology' ELSE 'capability' END, 'heuristic_keyword' FROM kw WHERE job_id NOT IN (SELECT job_id FROM h)""",
    "c19_freshness": """SELECT d.doc_id::VARCHAR AS job_id, d.item_id, CASE WHEN b.item_id IS NULL THEN 'missing' WHEN length(b.text) % 3 = 0 THEN 'invalid' WHEN s.doc_id IS NULL THEN 'stale' ELSE 'ok' END AS status
        FROM (SELECT doc_id, doc_id % (SELECT max(item_id) + 10 FROM benchmark) AS item_id FROM documents) d LEFT JOIN benchmark b USING (item_id) LEFT JOIN same s USING (doc_id, item_id)""",
    "d01_expansion": f"SELECT {JPX}, seq, canonical_skill, n_evidence AS n FROM status",
    "d02_source_texts": "SELECT 'Achievement' AS label, achievement_id AS key, description AS source FROM achievement UNION ALL SELECT 'Project', project_id, name FROM project UNION ALL SELECT 'Role', role_id, title FROM role UNION ALL SELECT 'Education', education_id, institution FROM education",
    "d03_provenance": "SELECT * FROM expanded",
    "d04_education_provenance": "SELECT person_id, canonical_skill, source, education FROM expanded WHERE education IS NOT NULL",
    "d05_distinct_evidence": f"SELECT {JPX}, seq, raw, n_evidence, n_evidence > 0 AS has_evidence FROM status",
    "d06_professional_context": "SELECT * FROM context",
    "d07_metrics": f"SELECT 'doc:' || doc_id AS id, regexp_matches(text, '{METRIC}') AS has_metric FROM documents UNION ALL SELECT achievement_id, regexp_matches(description, '{METRIC}') FROM achievement",
    "d08_strength": "SELECT * EXCLUDE (s) FROM ev",
    "d09_transferable": f"SELECT t.job_id, person_id, seq, place, capability_query, capability_skill, capability_match, reason, source, coalesce(n_evidence, 0) AS n_evidence FROM app JOIN trans t USING (job_id) LEFT JOIN evn ON evn.person_id = app.person_id AND evn.canonical_skill = capability_skill".replace(", person_id,", ", app.person_id,"),
    "d10_buckets": f"SELECT {JPX}, seq, bucket FROM status",
    "d11_match_summary": f"""SELECT {JPX}, count(*) AS n_requirements, count(*) FILTER (bucket = 'matched') AS n_matched, count(*) FILTER (bucket = 'partial') AS n_partial, count(*) FILTER (bucket = 'gap') AS n_gaps,
        count(*) FILTER (bucket = 'gap' AND h) AS n_transferable_gaps, count(*) FILTER (bucket = 'gap' AND NOT h) AS n_hard_gaps, round(count(*) FILTER (bucket = 'matched') / count(*), 4) AS matched_share
        FROM (SELECT s.*, EXISTS (FROM trans t WHERE t.job_id = s.job_id AND t.seq = s.seq) AS h FROM status s) GROUP BY ALL""",
    "d12_gap_reasons": f"SELECT {JPX}, seq, gap_reason FROM status WHERE bucket = 'gap'",
    "d13_review_groups": f"""SELECT {JPX}, seq, CASE bucket WHEN 'matched' THEN 'matched' WHEN 'partial' THEN 'low_confidence' ELSE CASE WHEN EXISTS (FROM trans t WHERE t.job_id = s.job_id AND t.seq = s.seq) THEN 'transferable' ELSE 'gap' END END AS review_group FROM status s""",
    "d14_strongest_evidence": f"SELECT {JPX}, seq, strongest FROM status",
    "d15_evidence_sources": f"SELECT {JPX}, seq, array_to_string(sources, '|') AS sources FROM status WHERE n_evidence > 0",
    "d16_evidence_paths": f"""SELECT k.job_id, k.person_id, n, concat_ws(' > ', 'Requirement=' || raw, 'Skill=' || canonical_skill, 'Source=' || source, 'Project=' || k.project, 'Role=' || k.role, 'Company=' || s.company, 'Education=' || s.education) AS path
        FROM keyed k LEFT JOIN story s USING ({KEY})""",
    "d17_requirement_matches": "SELECT job_id, raw AS requirement, skill_query, importance, category, canonical_skill, match_confidence AS confidence, match_type, recommendation FROM acc",
    "e01_group_keys": f"SELECT {JPX}, n, story_type, label FROM keyed",
    "e02_story_aggregates": f"SELECT {KEY}, source_type, professional_context, array_to_string(direct_skills, '|') AS direct_skills, first_seen FROM agg",
    "e03_story_achievements": f"SELECT {KEY}, description, array_to_string(matched_skills, '|') AS matched_skills, evidence_strength, first_seen, has_metric FROM sach",
    "e04_story_requirements": "SELECT * FROM sreq",
    "e05_story_strength": f"SELECT {KEY}, evidence_strength FROM agg",
    "e06_project_details": "SELECT * FROM pdet",
    "e07_role_details": "SELECT * FROM rdet",
    "e08_education_details": "SELECT institution AS name, description, program, status, start_date, end_date FROM education",
    "e09_skill_details": "SELECT name, display_name, category FROM skill",
    "e10_stories": f"SELECT {KEY}, source_type, project, {PROPS} FROM story",
    "e11_ranked_stories": f"SELECT {KEY}, rank, n_achievements, required_count, len(supports) AS n_supports, evidence_strength FROM story",
    "e12_preview": f"""SELECT {JPX}, rank, label, source_type, evidence_strength, professional_context, array_to_string(list_transform(achs[1:2], lambda a: CASE WHEN length(a) <= 90 THEN a ELSE left(a, 89) || '…' END), chr(10)) AS achievements FROM story WHERE rank <= 3""",
    "e13_skill_summary": "SELECT * FROM skills",
    "f01_slugs": f"SELECT name, {_slug("'-- ' || display_name || ' (§) ' || category")} AS slug FROM skill",
    "f02_education_home": f"SELECT {KEY}, home FROM parts",
    "f03_partition": f"SELECT {KEY}, class, group_key FROM parts",
    "f04_relevance": f"SELECT {GROUPX}, score, array_to_string(supported, '|') AS supported FROM scored",
    "f05_inclusion": f"SELECT {GROUPX}, recommendation, reason FROM x",
    "f06_professional": f"SELECT {JPX}, group_key, {E0}, organization, location, work_mode, array_to_string(projects, '|') AS projects, start_date, end_date, array_to_string(skills, '|') AS skills, n_achievements, score FROM x WHERE class = 'professional'",
    "f07_independent": f"SELECT {JPX}, group_key, {E0}, person_role, location, work_mode, start_date, end_date, array_to_string(skills, '|') AS skills, n_achievements, score FROM x WHERE class = 'independent'",
    "f08_education": f"SELECT {JPX}, group_key, {E0}, program, status, array_to_string(projects, '|') AS projects, '' AS roles, start_date, end_date, array_to_string(skills, '|') AS skills, n_achievements, score FROM x WHERE class = 'education'",
    "f09_reference_projects": """SELECT DISTINCT p.job_id, p.person_id, p.group_key, j.name FROM parts p JOIN edges b ON b.type = 'BUILT' AND b.src_key = p.person_id JOIN edges o ON o.type = 'PART_OF' AND o.src_key = b.dst_key JOIN education d ON d.education_id = o.dst_key AND d.institution = p.group_key
        JOIN project j ON j.project_id = b.dst_key WHERE p.class = 'education' AND NOT EXISTS (FROM parts q WHERE q.job_id = p.job_id AND q.person_id = p.person_id AND q.class = 'education' AND q.group_key = p.group_key AND q.project = j.name)""",
    "f10_technologies": f"SELECT {GROUPX}, array_to_string(technologies, '|') AS technologies FROM x",
    "f11_metrics": f"SELECT {GROUPX}, array_to_string(metrics, '|') AS metrics FROM x",
    "f12_achievement_evidence": f"SELECT {GROUPX}, label, achievement_id, text, metric, regexp_matches(text, '{METRIC}') OR metric IS NOT NULL AS has_metric, array_to_string(sk, '|') AS skills FROM achev",
    "f13_zero_roles": "SELECT * EXCLUDE (titles), array_to_string(titles, '|') AS titles FROM zr",
    "f14_zero_projects": "SELECT * FROM zp",
    "f15_curriculum": "SELECT DISTINCT institution, name FROM edges JOIN project ON project_id = src_key JOIN education ON education_id = dst_key WHERE edges.type = 'PART_OF'",
    "f16_order": f"""SELECT {JPX}, experience_id, title, experience_type, score, row_number() OVER (PARTITION BY {JPX} ORDER BY score DESC, CASE WHEN experience_type = 'professional' THEN 0 ELSE 1 END, CASE class WHEN 'professional' THEN 1 WHEN 'independent' THEN 2 ELSE 3 END, first_rank) AS place FROM x""",
    "f17_registry": "SELECT * FROM reg",
    "f18_requirement_summary": "SELECT job_id, person_id, seq, doc.requirement, doc.skillQuery, doc.importance, doc.category, doc.matchType, doc.matchConfidence, doc.recommendation, doc.literalStatus, to_json(doc.evidence)::VARCHAR AS evidence, to_json(doc.transferableEvidence)::VARCHAR AS transferableEvidence FROM reqsum",
    "f19_transferable_list": f"""WITH f AS (SELECT job_id, person_id, canonical_skill AS capability_skill, first(experience ORDER BY {SIX}) AS experience, first(evidence_strength ORDER BY {SIX}) AS evidence_strength FROM located GROUP BY ALL)
        SELECT {JPX}, seq, raw, bucket AS literal_status, CASE bucket WHEN 'gap' THEN 1 WHEN 'partial' THEN 2 WHEN 'matched' THEN 3 ELSE 0 END AS status_order, place, coalesce(capability_skill, capability_query) AS capability, experience, evidence_strength, reason
        FROM status JOIN trans USING (job_id, seq) LEFT JOIN f USING (job_id, person_id, capability_skill)""",
    "f20_relevant_skills": f"""WITH l AS (SELECT DISTINCT {JPX}, canonical_skill AS name FROM status WHERE bucket IN ('matched', 'partial')), t AS (SELECT DISTINCT {JPX}, capability_skill AS name FROM status JOIN trans USING (job_id, seq) EXCEPT SELECT * FROM l)
        SELECT s.*, relevance FROM skills s JOIN (SELECT *, 'literal' AS relevance FROM l UNION ALL SELECT *, 'transferable' FROM t) USING (job_id, person_id, name) WHERE category <> 'language'""",
    "f21_languages": f"""SELECT s.job_id, s.person_id, name, display_name, '' AS proficiency, coalesce(e, '') AS evidence FROM skills s LEFT JOIN (SELECT {JPX}, name, array_to_string(list_sort(list(DISTINCT label)), '|') AS e FROM (SELECT {JPX}, label, unnest(direct_skills) AS name FROM story) GROUP BY ALL) USING (job_id, person_id, name) WHERE category = 'language'""",
    "f22_themes": f"""WITH n AS (SELECT DISTINCT {JPX}, canonical_skill AS name FROM status WHERE bucket IN ('matched', 'partial') UNION SELECT {JPX}, name FROM skills WHERE category <> 'language'),
        o AS (SELECT {JPX}, split_part(name, ' ', -1) AS noun, count(*) AS overlap FROM n GROUP BY ALL)
        SELECT * FROM (SELECT {JPX}, row_number() OVER (PARTITION BY {JPX} ORDER BY overlap DESC, list_position(['ring','bolt','plate','rod','gear','gizmo','anvil','widget'], noun)) AS place, 'theme ' || noun AS theme, overlap FROM o) WHERE place <= 5""",
    "f23_provenance": f"""SELECT {GROUPX}, rank, source_type, CASE WHEN NOT (class = 'education' AND source_type = 'Education') THEN project END AS project, CASE WHEN class = 'education' THEN CASE WHEN source_type = 'Role' THEN label END ELSE role_title END AS role,
        CASE WHEN class = 'professional' OR (class = 'education' AND source_type = 'Role') THEN company END AS company, CASE WHEN class = 'education' THEN home END AS education,
        CASE WHEN class = 'professional' AND project IS NOT NULL THEN 'DURING' WHEN class = 'education' AND source_type = 'Project' THEN 'PART_OF' END AS relationship FROM parts""",
    "g01_skill_buckets": "SELECT name, CASE category WHEN 'technical' THEN 'programming' WHEN 'tool' THEN 'tools' ELSE 'capabilities' END AS bucket FROM skill",
    "g02_partial_dates": f"SELECT project_id, {_date('start_date')} AS shown FROM project UNION ALL SELECT role_id, {_date('start_date')} FROM role",
    "g03_sections": f"SELECT {KEY}, section FROM routed",
    "g04_achievement_bullets": f"SELECT {KEY}, array_to_string(list_transform(achs[1:4], lambda a: a || ' [' || a || ']'), '|') AS bullets FROM routed",
    "g05_fallback_bullets": f"SELECT {KEY}, {NB} FROM bul",
    "g06_experience_entries": f"SELECT * EXCLUDE (bullets), {NB} FROM exp_entries",
    "g07_project_entries": f"SELECT * EXCLUDE (bullets), {NB} FROM pro_entries",
    "g08_education_entries": f"SELECT * EXCLUDE (bullets), {NB} FROM edu_entries",
    "g09_skills_by_bucket": "SELECT job_id, person_id, bucket, array_to_string(names, '|') AS names FROM bucketed",
    "g10_substantial": f"SELECT {KEY}, substantial FROM routed",
    "g11_prominent_tech": "SELECT job_id, person_id, array_to_string(tech, '|') AS tech, tech_text FROM techt",
    "g12_profiles": "SELECT * FROM prof",
    "g13_languages": "SELECT job_id, person_id, array_to_string(list_sort(list(display_name)), '|') AS languages FROM skills WHERE category = 'language' GROUP BY ALL",
    "g15_rendered_text": "SELECT * FROM rendered",
    "g17_audit": r"""WITH gaps AS (SELECT DISTINCT job_id, person_id, skill_query AS what FROM status WHERE bucket = 'gap'), firstgap AS (SELECT job_id, person_id, min(what) AS gap FROM gaps GROUP BY ALL),
        said AS (SELECT job_id, person_id, text || coalesce(CASE WHEN m[1] BETWEEN '4' AND '7' THEN b[ascii(m[2]) % 6 + 1] WHEN m[1] IN ('8', '9', 'a', 'b') THEN 'Also ' || gap END || chr(10), '') AS text
          FROM (SELECT *, md5(job_id || ':' || person_id) AS m, ['Note on role alignment', 'Skills used:', 'Evidence-backed match', 'no evidence found', 'match-confidence', 'matchConfidence'] AS b FROM rendered) LEFT JOIN firstgap USING (job_id, person_id)),
        faulty AS (SELECT *, CASE WHEN source_type = 'Education' THEN 0 ELSE 1 END AS edu FROM bul WHERE rank = 1 AND md5(job_id || ':' || person_id)[1] BETWEEN '0' AND '3' AND section IS NOT NULL),
        kept AS (SELECT b.*, row_number() OVER (PARTITION BY job_id, person_id, home ORDER BY CASE WHEN source_type = 'Education' THEN 0 ELSE 1 END, rank) AS k FROM bul b WHERE section = 'education'),
        edu AS (SELECT job_id, person_id, home, rank, k, CASE WHEN k = 1 THEN CASE WHEN description <> '' THEN [description] ELSE [] END ELSE bullets END AS shown FROM kept),
        upto AS (SELECT *, coalesce(sum(len(shown)) OVER (PARTITION BY job_id, person_id, home ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM edu),
        bare AS (SELECT job_id, person_id, unnest(bullets) AS x FROM faulty WHERE section <> 'education'
          UNION ALL SELECT job_id, person_id, unnest(shown[1:greatest(0, 4 - before)::INT]) FROM upto WHERE rank = 1 AND k > 1 AND md5(job_id || ':' || person_id)[1] BETWEEN '0' AND '3')
        SELECT job_id, person_id, 'no_evidence_id' AS issue, regexp_replace(x, ' \[[^\]]*\]$', '') AS what FROM bare
        UNION ALL SELECT job_id, person_id, 'gap_named', what FROM gaps JOIN said USING (job_id, person_id) WHERE regexp_matches(lower(text), '(^|[^a-z0-9])' || regexp_escape(what) || '([^a-z0-9]|$)')
        UNION ALL SELECT job_id, person_id, 'banned_phrase', what FROM said, unnest(['Note on role alignment', 'Skills used:', 'Evidence-backed match', 'no evidence found', 'match-confidence', 'matchConfidence']) AS b(what) WHERE contains(lower(text), lower(what))""",
    "f18_requirement_buckets": f"SELECT {JPX}, {_lists('matched', 'partial', 'gaps', json=True)} FROM app LEFT JOIN buckets USING (job_id, person_id)",
    "e14_context_documents": "SELECT job_id, person_id, to_json(doc)::VARCHAR AS context FROM context_docs",
    "f24_packages": "SELECT job_id, person_id, to_json(doc)::VARCHAR AS package FROM package_docs",
    "g14_structured_documents": "SELECT job_id, person_id, to_json(doc)::VARCHAR AS document FROM structured_docs",
    "g16_prompts": """SELECT 'extraction' AS kind, doc_id::VARCHAR AS job_id, NULL AS person_id, 'List the hiring requirements of the following text as JSON, each with its wording, a short skill query, an importance and a category.' || chr(10) || chr(10) || 'TEXT:' || chr(10) || chr(10) || coalesce(text, '') AS prompt FROM documents
        UNION ALL SELECT 'document', job_id, person_id, 'Write a short professional document from this context. Claim nothing that it does not support.' || chr(10) || chr(10) || 'CONTEXT:' || chr(10) || chr(10) || to_json(doc)::VARCHAR FROM context_docs""",
}


def _needed(sql: str, known: dict[str, set[str]]) -> set[str]:
    return {n for n in known if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", sql)}


def with_views(sql: str) -> str:
    """``sql`` after the expressions it needs, in the order of their definition."""
    uses = {n: set() for n in CTE}
    for n, body in CTE.items():
        uses[n] = _needed(body, uses) - {n}
    wanted, todo = set(), _needed(sql, uses)
    while todo:
        n = todo.pop()
        if n not in wanted:
            wanted.add(n)
            todo |= uses[n]
    views = ",\n".join(f"{n} AS ({CTE[n]})" for n in CTE if n in wanted)
    if not views:
        return sql
    body = sql[5:] if sql.startswith("WITH ") else None
    return f"WITH {views},\n{body}" if body else f"WITH {views}\n{sql}"


def oracle_sql() -> dict[str, str]:
    return {n: with_views(sql) for n, sql in ORACLES.items()}
