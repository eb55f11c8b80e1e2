"""SQL of the readiness checks, over the CTEs of the adapters.

Look-behind is not to be had in the oracle's patterns: sentences are cut at a sentinel.
"""

from __future__ import annotations

from scriptorium.functions import patterns as P
from scriptorium.plans import adapters as X
from scriptorium.plans.rule_queries import _MISSING, AS_OF_YEAR


def _text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _sum_matches(column: str, many) -> str:
    return " + ".join(f"(CASE WHEN regexp_matches({column}, {_text(p)}, 'i') THEN 1 ELSE 0 END)" for p in many)


def _moves_missing() -> str:
    return " + ".join(f"(CASE WHEN len(list_filter(sentences, lambda s: regexp_matches(s, {_text(p)}, 'i'))) > 0 THEN 0 ELSE 1 END)" for p in P.MOVES.values())


def _check(category: str, key: str, score: str, weight: str, severity: str, where: str = "true", source: str = "f") -> str:
    return f"SELECT ms_id, profile_id, '{category}' AS category, '{key}' AS key, ({score})::DOUBLE AS score, ({weight})::DOUBLE AS weight, {severity} AS severity FROM {source} WHERE {where}"


_ok = lambda ok, otherwise: f"CASE WHEN {ok} THEN 'ok' ELSE {otherwise} END"
_SCOPE = "list_filter(scope_keywords, lambda t: contains(hay, ' ' || trim(regexp_replace(lower(t), '[^\\w]+', ' ', 'g')) || ' '))"
_FRACTION = f"least(1.0, len({_SCOPE}) / greatest(1, least(len(scope_keywords), 12))::DOUBLE * 2)"
_HI, _LO = "coalesce(nullif(abstract_max_words, 0), 10000)", "coalesce(nullif(abstract_min_words, 0), 0)"
_NEED = "list_contains(required_sections, 'data_availability')"
_HAVE = "list_contains(present, 'data_availability')"
_EXPECTED = "CASE WHEN greatest(1, words) < 5000 THEN 30 WHEN words < 9000 THEN 45 ELSE 60 END"
_RATIO = f"(n_refs / ({_EXPECTED})::DOUBLE)"
_COUNT = f"(CASE WHEN {_RATIO} >= 0.75 THEN 1.0 ELSE {_RATIO} / 0.75 END)"
_RECENT = "(CASE WHEN n_refs > 0 THEN least(1.0, recent / n_refs::DOUBLE / 0.5) ELSE 0.4 END)"
_DENSITY = "((n_figs + n_tabs) / (greatest(1, words) / 1000.0::DOUBLE))"
_QUANT = f"len(regexp_extract_all(abstract_raw, {_text(P.QUANTITY)}))"
_FOREIGN = f"(regexp_matches(abstract_raw, {_text(P.CITATION_IN_ABSTRACT)}) OR regexp_matches(abstract_raw, {_text(P.FLOAT_IN_ABSTRACT)}))"
_SOME = "abstract_words > 0"
_TITLE = "len(regexp_extract_all(title, '[^\\s]+'))"
_KEYS = "(len(keywords) BETWEEN coalesce(nullif(keywords_min, 0), 0) AND coalesce(nullif(keywords_max, 0), 99))"

CHECKS = X.CORPUS + rf""", all_texts AS (
  SELECT ms_id, string_agg(part, chr(10) ORDER BY sec_ord, k) AS all_text
  FROM (SELECT ms_id, sec_ord, 0 AS k, title_raw AS part FROM sections WHERE title_raw <> '' UNION ALL SELECT ms_id, sec_ord, 1, text FROM sections) GROUP BY ms_id),
introductions AS (SELECT ms_id, arg_min(text, sec_ord) AS introduction FROM sections WHERE role = 'introduction' GROUP BY ms_id),
per_ref AS (SELECT ms_id, count(*) AS n_refs, count(*) FILTER (WHERE {AS_OF_YEAR} - year <= 5) AS recent, count(*) FILTER (WHERE doi <> '') AS with_doi, count(*) FILTER (WHERE confidence < 0.6) AS low_refs FROM refs GROUP BY ms_id),
per_fig AS (
  SELECT ms_id, profile_id, count(*) AS n_figs, count(*) FILTER (WHERE caption_raw = '') AS uncaptioned,
         count(*) FILTER (WHERE list_contains(list_transform(rejected_formats, lambda x: lower(x)), fmt)
           OR (NOT is_vector AND coalesce(width_px, 0) <> 0 AND coalesce(placed_width_mm, 0) <> 0 AND width_px / (placed_width_mm / 25.4) < dpi_halftone)) AS unfit
  FROM figures CROSS JOIN profiles GROUP BY ms_id, profile_id),
per_tab AS (SELECT ms_id, count(*) AS n_tabs FROM tables_ GROUP BY ms_id),
f0 AS (
  SELECT b.*, a.all_text, i.introduction, coalesce(r.n_refs, 0) AS n_refs, coalesce(recent, 0) AS recent, coalesce(with_doi, 0) AS with_doi, coalesce(low_refs, 0) AS low_refs,
         coalesce(n_figs, 0) AS n_figs, coalesce(uncaptioned, 0) AS uncaptioned, coalesce(unfit, 0) AS unfit, coalesce(n_tabs, 0) AS n_tabs,
         concat_ws(' ', title, trim(abstract_raw), introduction) AS front,
         ' ' || regexp_replace(lower(concat_ws(' ', title, array_to_string(keywords, ' '), abstract_raw)), '[^\w]+', ' ', 'g') || ' ' AS hay,
         list_filter(list_transform(string_split(regexp_replace(trim(abstract_raw), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') AS sentences,
         list_filter(list_transform(string_split(regexp_replace(all_text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: len(regexp_extract_all(s, '[^\s]+'))), lambda n: n > 2) AS lengths,
         len(regexp_extract_all(all_text, '[^\s]+')) AS all_words,
         len(regexp_extract_all(regexp_replace(all_text, '\s+', '  ', 'g'), {_text(P.HEDGE.replace(' ', '  '))})) AS hedges
  FROM both_ b LEFT JOIN all_texts a ON a.ms_id = b.ms_id LEFT JOIN introductions i ON i.ms_id = b.ms_id LEFT JOIN per_ref r ON r.ms_id = b.ms_id
  LEFT JOIN per_fig g ON g.ms_id = b.ms_id AND g.profile_id = b.profile_id LEFT JOIN per_tab t ON t.ms_id = b.ms_id),
f AS (
  SELECT *, {_moves_missing()} AS moves, {_sum_matches('front', P.NOVELTY)} AS novel, {_sum_matches('all_text', P.REPRODUCIBILITY.values())} AS repro,
         list_sum(lengths) / nullif(len(lengths), 0)::DOUBLE AS mean_words, len(list_filter(lengths, lambda n: n > 40)) / nullif(len(lengths), 0)::DOUBLE AS long_share,
         hedges / greatest(1.0, all_words / 1000.0::DOUBLE) AS hedging
  FROM f0),
checks_ AS (
""" + " UNION ALL ".join([
    _check("Scope fit", "scope.match", "1", "0", "'info'", "len(scope_keywords) = 0"),
    _check("Scope fit", "scope.match", _FRACTION, "3", f"CASE WHEN {_FRACTION} >= 0.67 THEN 'ok' WHEN {_FRACTION} >= 0.34 THEN 'minor' ELSE 'major' END", "len(scope_keywords) > 0"),
    _check("Structure", "structure.required", f"1 - len({_MISSING}) / greatest(1, len(required_sections))::DOUBLE", "3", f"CASE WHEN len({_MISSING}) > 0 AND unlabelled > 0 THEN 'minor' WHEN len({_MISSING}) = 0 THEN 'ok' WHEN len({_MISSING}) > 2 THEN 'blocker' ELSE 'major' END"),
    _check("Structure", "structure.keywords", f"CASE WHEN {_KEYS} THEN 1 ELSE 0 END", "1", _ok(_KEYS, "'minor'")),
    _check("Structure", "structure.title", f"CASE WHEN {_TITLE} BETWEEN 6 AND 20 THEN 1.0 WHEN {_TITLE} > 0 THEN 0.5 ELSE 0.0 END", "1", _ok(f"{_TITLE} BETWEEN 6 AND 20", "'minor'")),
    _check("Abstract", "abstract.present", "0", "4", "'blocker'", "abstract_words = 0"),
    _check("Abstract", "abstract.length", f"CASE WHEN abstract_words > {_HI} THEN greatest(0.0, 1 - (abstract_words - {_HI}) / {_HI}::DOUBLE) WHEN {_LO} > 0 AND abstract_words < {_LO} THEN abstract_words / {_LO}::DOUBLE ELSE 1.0 END", "2", f"CASE WHEN abstract_words > {_HI} THEN 'major' WHEN {_LO} > 0 AND abstract_words < {_LO} THEN 'minor' ELSE 'ok' END", _SOME),
    _check("Abstract", "abstract.moves", "1 - moves / 5.0::DOUBLE", "2", "CASE WHEN moves = 0 THEN 'ok' WHEN moves > 1 THEN 'major' ELSE 'minor' END", _SOME),
    _check("Abstract", "abstract.quantified", f"CASE WHEN {_QUANT} >= 2 THEN 1.0 WHEN {_QUANT} = 1 THEN 0.5 ELSE 0.0 END", "1.5", _ok(f"{_QUANT} >= 2", "'major'"), _SOME),
    _check("Abstract", "abstract.selfcontained", f"CASE WHEN {_FOREIGN} THEN 0 ELSE 1 END", "1.5", _ok(f"NOT {_FOREIGN}", "'major'"), _SOME),
    _check("Abstract", "abstract.novelty", "CASE WHEN novel > 0 THEN 1 ELSE 0 END", "2", _ok("novel > 0", "'major'"), _SOME),
    _check("References", "refs.present", "0", "3", "'blocker'", "n_refs = 0"),
    _check("References", "refs.count", _COUNT, "1.5", _ok(f"{_COUNT} >= 1", "'major'"), "n_refs > 0"),
    _check("References", "refs.recency", _RECENT, "1.5", _ok(f"{_RECENT} >= 1", "'major'"), "n_refs > 0"),
    _check("References", "refs.doi", "with_doi / n_refs::DOUBLE", "CASE WHEN doi_required THEN 1.5 ELSE 0.8 END", _ok("with_doi / n_refs::DOUBLE > 0.9", "CASE WHEN doi_required THEN 'major' ELSE 'minor' END"), "n_refs > 0"),
    _check("References", "refs.consistency", "1 - low_refs / n_refs::DOUBLE", "1", _ok("1 - low_refs / n_refs::DOUBLE > 0.85", "'minor'"), "n_refs > 0"),
    _check("Figures and tables", "figs.density", f"CASE WHEN {_DENSITY} BETWEEN 0.5 AND 2.5 THEN 1.0 ELSE 0.6 END", "0.8", _ok(f"{_DENSITY} BETWEEN 0.5 AND 2.5", "'minor'")),
    _check("Figures and tables", "figs.captions", "1 - uncaptioned / n_figs::DOUBLE", "1.2", _ok("uncaptioned = 0", "'major'"), "n_figs > 0"),
    _check("Figures and tables", "figs.production", "1 - unfit / n_figs::DOUBLE", "2", "CASE WHEN unfit = 0 THEN 'ok' WHEN 1 - unfit / n_figs::DOUBLE < 0.5 THEN 'blocker' ELSE 'major' END", "n_figs > 0"),
    _check("Reproducibility", "repro.signals", "repro / 4.0::DOUBLE", "1.5", _ok("repro >= 3", "'major'")),
    _check("Reproducibility", "repro.statement", f"CASE WHEN {_HAVE} THEN 1 ELSE 0 END", f"CASE WHEN {_NEED} THEN 1.2 ELSE 0.6 END", _ok(_HAVE, f"CASE WHEN {_NEED} THEN 'major' ELSE 'minor' END")),
    _check("Writing signals", "writing.sentences", "CASE WHEN mean_words BETWEEN 14 AND 26 AND long_share < 0.1 THEN 1.0 ELSE 0.6 END", "0.8", _ok("mean_words BETWEEN 14 AND 26 AND long_share < 0.1", "'minor'"), "len(lengths) > 0"),
    _check("Writing signals", "writing.hedging", "CASE WHEN hedging <= 12 THEN 1.0 ELSE 0.6 END", "0.6", _ok("hedging <= 12", "'minor'"), "len(lengths) > 0"),
]) + """),
by_category AS (SELECT ms_id, profile_id, category, coalesce(sum(score * weight) / nullif(sum(weight), 0), 1.0) AS category_score FROM checks_ GROUP BY ALL),
weights AS (SELECT unnest(['Scope fit', 'Structure', 'Abstract', 'References', 'Figures and tables', 'Reproducibility', 'Writing signals']) AS category, unnest([1.4, 1.2, 1.2, 1.0, 1.0, 0.9, 0.6]::DOUBLE[]) AS w),
ready_ AS (
  SELECT i.ms_id, i.profile_id, sum(coalesce(c.category_score, 1.0) * w.w) / sum(w.w) AS readiness
  FROM (SELECT DISTINCT ms_id, profile_id FROM checks_) i CROSS JOIN weights w LEFT JOIN by_category c ON c.ms_id = i.ms_id AND c.profile_id = i.profile_id AND c.category = w.category GROUP BY ALL),
ordered AS (
  SELECT *, list_position(['scope.match', 'structure.required', 'structure.keywords', 'structure.title', 'abstract.present', 'abstract.length', 'abstract.moves', 'abstract.quantified', 'abstract.selfcontained', 'abstract.novelty', 'refs.present', 'refs.count', 'refs.recency', 'refs.doi', 'refs.consistency', 'figs.density', 'figs.captions', 'figs.production', 'repro.signals', 'repro.statement', 'writing.sentences', 'writing.hedging'], key) AS seq,
         list_position(['blocker', 'major', 'minor', 'info', 'ok'], severity) AS rank
  FROM checks_)
"""  # fmt: skip

ORACLES = {
    "i_review_checks": CHECKS + "SELECT ms_id, profile_id, category, key, round(score, 9) AS score, weight, severity FROM checks_",
    "e_08_category_scores": CHECKS + "SELECT ms_id, profile_id, category, round(category_score, 9) AS category_score FROM by_category",
    "f_09_priorities": CHECKS + "SELECT * FROM (SELECT ms_id, profile_id, row_number() OVER (PARTITION BY ms_id, profile_id ORDER BY rank, -(1 - score) * weight, seq) AS place, key, severity FROM ordered WHERE score < 0.99) WHERE place <= 8",
    "f_10_weakest": CHECKS + "SELECT category, key, count(*) AS manuscripts FROM (SELECT *, row_number() OVER (PARTITION BY ms_id, profile_id, category ORDER BY score, weight DESC, seq) AS place FROM ordered WHERE score < 0.99) WHERE place = 1 GROUP BY ALL",
    "f_11_desk_risk": CHECKS + """, m AS (
      SELECT o.ms_id, o.profile_id, max(score) FILTER (WHERE key = 'scope.match') AS scope, list(key ORDER BY seq) FILTER (WHERE severity = 'blocker') AS blockers, list(key ORDER BY seq) FILTER (WHERE severity = 'major') AS majors FROM ordered o GROUP BY ALL)
      SELECT m.ms_id, m.profile_id, round(readiness, 9) AS readiness,
             CASE WHEN blockers IS NOT NULL OR scope < 0.34 THEN 'High' WHEN coalesce(len(majors), 0) >= 3 OR readiness < 0.6 THEN 'Moderate' ELSE 'Low' END AS band,
             array_to_string(list_concat(list_concat(CASE WHEN scope < 0.34 THEN ['scope'] ELSE []::VARCHAR[] END, coalesce(blockers, [])), list_slice(coalesce(majors, []), 1, 4)), ',') AS reasons
      FROM m JOIN ready_ r ON r.ms_id = m.ms_id AND r.profile_id = m.profile_id""",
}
