"""The registry's results as DuckDB SQL over the driver's tables: named parts, each query with those it needs."""

from __future__ import annotations

import re

from tipoff.functions import seasons as S
from tipoff.sources import domain


def _slug(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"


def _ladder(x: str, steps, rest, below: bool = False, kind: str = "") -> str:
    lit = lambda v: f"'{v}'" if isinstance(v, str) else f"{v}{kind}"
    return "CASE " + " ".join(f"WHEN {x} {'<' if below else '<='} {b} THEN {lit(v)}" for b, v in steps) + f" WHEN {x} IS NOT NULL THEN {lit(rest)} END"


def _z(m: str, cap: bool = True) -> str:
    z = f"(({m})::DOUBLE - coalesce({m}_mean, 0)) / CASE WHEN {m}_sd > 0 THEN {m}_sd ELSE 1 END"
    return f"CASE WHEN {m} IS NOT NULL AND NOT isnan(({m})::DOUBLE) THEN {f'greatest(-3.5::DOUBLE, least(3.5::DOUBLE, {z}))' if cap else z} END"


def _stats(metrics: tuple[str, ...]) -> str:
    return ", ".join(f"avg({m}) AS {m}_mean, stddev_pop({m}) AS {m}_sd" for m in metrics)


def _up(x: str, digits: int) -> str:
    return f"(floor(({x}) * {10**digits}::DOUBLE + 0.5::DOUBLE) / {10**digits}::DOUBLE)"


def _season(y: str) -> str:
    return f"CAST({y} AS VARCHAR) || '-' || lpad(CAST(({y} + 1) % 100 AS VARCHAR), 2, '0')"


_NICK = "[" + ", ".join(f"'{n}'" for n in domain.NICKNAMES) + "]"
_RESULTS = " ".join(f"WHEN regexp_matches(clean, '{p}') THEN {{'round': '{r}', 'points': {v}::DOUBLE}}" for p, r, v in S.RESULTS)
_CLOSE = """CASE WHEN close_wins + close_losses >= 1 THEN (close_wins + 1) / (close_wins + close_losses + 2) * 0.6::DOUBLE
  + CASE WHEN clutch_wins + clutch_losses > 0 THEN (clutch_wins + 1) / (clutch_wins + clutch_losses + 2) ELSE (close_wins + 1) / (close_wins + close_losses + 2) END * 0.4::DOUBLE END"""
_KINDS = {"close": "abs(pts - opp_pts) <= 5", "clutch": "abs(pts - opp_pts) <= 3", "overtime": "abs(pts - opp_pts) <= 3 AND pts + opp_pts > 150"}
_CLOSE_COUNTS = ", ".join(f"count(*) FILTER ({t} AND {'pts > opp_pts' if s == 'wins' else 'NOT pts > opp_pts'}) AS {k}_{s}" for k, t in _KINDS.items() for s in ("wins", "losses"))
_PERFECT = "CASE WHEN win_pct >= 1 AND wins >= 20 THEN 0.3::DOUBLE + (wins - 20) * 0.015::DOUBLE WHEN losses = 1 AND wins >= 28 THEN 0.15::DOUBLE ELSE 0 END"
_GROW = f"(log2(68::DOUBLE) / log2(({_ladder('end_year', S.FIELDS, S.FIELD_REST)})::DOUBLE))"
_TOURNAMENT = f"CASE WHEN result.round = 'in_progress' OR (result.round = 'none' AND end_year >= 2026) THEN 0 WHEN result.points > 0 THEN result.points * {_GROW} / 15 ELSE result.points / {_GROW} / 15 END"
_POLLS = "CASE WHEN ap_high IS NOT NULL OR ap_final IS NOT NULL THEN coalesce(-(z_ap_high), 0) * 0.40::DOUBLE + coalesce(-(z_ap_final), 0) * 0.35::DOUBLE + CASE WHEN ap_high <= 1 THEN 0.5::DOUBLE WHEN ap_high <= 3 THEN 0.25::DOUBLE WHEN ap_high <= 5 THEN 0.125::DOUBLE ELSE 0 END END"
_METRICS = ("em", "sos", "win_pct", "conf_pct", "ap_high", "ap_final", "srs", "sr_sos", "quality_record", "close_score", "prestige", "draft_score")
_EARLIER = ("win_pct", "margin", "srs", "sr_sos", "conf_pct", "ap_pre", "ap_high", "ap_final")
_WEIGHTS = {"efficiency": 0.30, "sos_part": 0.12, "tournament": 0.18, "quality": 0.10, "perception": 0.10, "close_game": 0.05, "coaching": 0.05, "draft": 0.05, "era_difficulty": 0.05}
_OLD_WEIGHTS = {"dominance": 0.35, "sos_part": 0.20, "tournament": 0.20, "conference": 0.10, "perception": 0.15}


def _shared(weights: dict[str, float]) -> str:
    return "(" + " + ".join(f"coalesce({k}, 0) * {w}::DOUBLE" for k, w in weights.items()) + ") / (" + " + ".join(f"CASE WHEN {k} IS NOT NULL THEN {w}::DOUBLE ELSE 0 END" for k, w in weights.items()) + ")"


def _scaled(power: float, size: float) -> str:
    return f"50 + raw * 15 + CASE WHEN raw > 1.5 THEN pow(greatest(raw - 1.5::DOUBLE, 0), {power}::DOUBLE) * {size}::DOUBLE ELSE 0 END"


_BOUNDED = """CASE WHEN wins = 0 AND losses > 0 THEN least(capped, 20) ELSE capped END AS score FROM (SELECT *, CASE WHEN wins + losses < 10 AND inside > 65 THEN 65 ELSE inside END AS capped FROM (SELECT *, greatest(0, least(100, open_score)) AS inside"""

CTES: dict[str, str] = {
    "nt": "SELECT count(*) AS n FROM supplier",
    "v_teams": f"SELECT *, {_slug('name')} AS slug FROM (SELECT *, school || ' ' || mascot AS name FROM (SELECT CAST(s_suppkey AS BIGINT) AS team_id, replace(s_name, '#', ' ') AS school, ({_NICK})[CAST(s_suppkey % {len(domain.NICKNAMES)} + 1 AS BIGINT)] AS mascot, n_name AS conf, r_name AS super FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey))",
    "half0": "SELECT CAST(l_suppkey AS BIGINT) AS team_id, CAST((l_suppkey + 1 + l_partkey % (n - 1)) % n AS BIGINT) AS opp, CAST(CAST(l_shipdate AS DATE) + CAST(l_orderkey % 10 * 96 - 480 AS INT) * INTERVAL 1 MONTH AS DATE) AS game_date, CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'R' THEN 'H' ELSE 'N' END AS loc, l_orderkey AS order_key, l_partkey, l_linenumber, CAST(floor(l_quantity) AS BIGINT) AS q FROM lineitem, nt",
    "half": "SELECT team_id, opp, game_date, loc, CASE WHEN order_key % 97 = 0 THEN 0 ELSE 40 + q + team_id % 7 END AS pts, CASE WHEN order_key % 97 = 0 THEN 0 ELSE 41 + (l_partkey * 7 + order_key * 3 + l_linenumber) % 50 + opp % 7 END AS opp_pts, order_key FROM half0",
    "both_sides": "SELECT * FROM half UNION ALL SELECT opp, team_id, game_date, CASE loc WHEN 'A' THEN 'H' WHEN 'H' THEN 'A' ELSE 'N' END, opp_pts, pts, order_key FROM half",
    "g0": "SELECT *, CASE WHEN order_key % 20 <> 0 THEN opp END AS opp_id, CAST(year(game_date) - CASE WHEN month(game_date) < 6 THEN 1 ELSE 0 END AS BIGINT) AS start_year FROM both_sides",
    "v_games": f"SELECT *, {_season('start_year')} AS season FROM g0",
    "s0": f"SELECT team_id, season, start_year, count(*) FILTER (pts > opp_pts) AS wins, count(*) FILTER (pts < opp_pts) AS losses, avg(pts) AS ppg, avg(opp_pts) AS opp_ppg, avg(pts - opp_pts) AS srs, count(*) FILTER (pts > opp_pts AND (team_id + opp) % 5 = 0) AS conf_wins, count(*) FILTER (pts < opp_pts AND (team_id + opp) % 5 = 0) AS conf_losses, {_CLOSE_COUNTS} FROM v_games GROUP BY team_id, season, start_year",
    "s1": "SELECT *, row_number() OVER (PARTITION BY season ORDER BY wins DESC, losses, team_id) AS place FROM s0",
    "v_seasons": f"""SELECT s1.* REPLACE (CASE WHEN start_year >= {domain.FIRST_POINTS} THEN ppg END AS ppg, CASE WHEN start_year >= {domain.FIRST_POINTS} THEN opp_ppg END AS opp_ppg, CASE WHEN start_year >= {domain.FIRST_SRS} THEN srs END AS srs),
  CASE WHEN start_year >= {domain.FIRST_SOS} THEN ((team_id * 13 + start_year * 7) % 41 - 20) / 2 END AS sr_sos, CASE WHEN wins + losses > 0 THEN wins / (wins + losses) END AS win_pct, CASE WHEN conf_wins + conf_losses > 0 THEN conf_wins / (conf_wins + conf_losses) END AS conf_pct, start_year + 1 AS end_year,
  CASE WHEN place <= 64 THEN (place - 1) // 4 + 1 END AS seed, CASE WHEN place <= 20 THEN place * 7 % 25 + 1 END AS ap_pre, CASE WHEN place <= 25 THEN place END AS ap_high, CASE WHEN place <= 22 THEN place + 3 END AS ap_final,
  CASE WHEN start_year = 2026 AND place <= 64 THEN 'Playing First Round' WHEN place = 1 THEN 'Won NCAA Tournament National Final*' WHEN place = 2 THEN 'Lost NCAA Tournament National Final' WHEN place <= 4 THEN 'Lost NCAA Tournament National Semifinal' WHEN place <= 8 THEN 'Lost NCAA Tournament Regional Final' WHEN place <= 16 THEN 'Lost NCAA Tournament Regional Semifinal' WHEN place <= 32 THEN 'Lost NCAA Tournament Second Round' WHEN place <= 64 THEN 'Lost NCAA Tournament First Round' END AS tourney,
  name, conf FROM s1 LEFT JOIN v_teams USING (team_id)""",
    "r0": f"SELECT *, 100 / ((pts + opp_pts) / {_ladder('start_year', S.POSSESSION_DIVISORS, S.POSSESSION_REST, True, '::DOUBLE')}) AS scale FROM v_games WHERE pts + opp_pts > 0 AND start_year >= {domain.FIRST_RATED}",
    "rated": "SELECT *, (pts - opp_pts + CASE loc WHEN 'H' THEN -3.5 WHEN 'A' THEN 3.5 ELSE 0 END::DOUBLE) * scale AS margin, pts * scale AS off, opp_pts * scale AS def, pts > opp_pts AS won FROM r0",
    "m0": "SELECT season, team_id, avg(margin) AS em, avg(off) AS oe, avg(def) AS de, count(*) AS games, count(*) FILTER (won) AS wins FROM rated GROUP BY ALL",
    "means": "SELECT *, games - wins AS losses, row_number() OVER (PARTITION BY season ORDER BY round(em, 6) DESC, team_id) AS rank FROM m0",
    "league": "SELECT season, avg(em) AS em, avg(oe) AS oe, avg(de) AS de FROM m0 GROUP BY season",
    "links": "SELECT r.season, r.team_id, r.opp_id, sum(margin) AS m, sum(off) AS o, sum(def) AS d, count(*) AS n FROM rated r JOIN m0 ON m0.season = r.season AND m0.team_id = r.opp_id GROUP BY ALL",
    "fix": """SELECT season, m0.team_id, m0.em, m0.oe - league.oe AS oe, m0.de - league.de AS de, 0 AS step, 1e9::DOUBLE AS moved FROM m0 JOIN league USING (season)
UNION ALL SELECT season, team_id, em - avg(em) OVER s, oe - avg(oe) OVER s, de - avg(de) OVER s, step + 1, max(abs(em - old)) OVER s FROM (
  SELECT f.season, f.team_id, f.step, f.em AS old,
    CASE WHEN u.met > 0 THEN 0.5::DOUBLE * (w * u.e / met + (1 - w) * l.em) + 0.5::DOUBLE * f.em ELSE f.em END AS em,
    CASE WHEN u.met > 0 THEN 0.5::DOUBLE * (w * u.o / met) + 0.5::DOUBLE * f.oe ELSE f.oe END AS oe, CASE WHEN u.met > 0 THEN 0.5::DOUBLE * (w * u.d / met) + 0.5::DOUBLE * f.de ELSE f.de END AS de
  FROM fix f JOIN league l ON l.season = f.season JOIN (SELECT season, team_id, CASE WHEN games < 10 THEN games / 10::DOUBLE ELSE 1::DOUBLE END AS w FROM m0) g ON g.season = f.season AND g.team_id = f.team_id
  LEFT JOIN (SELECT k.season, k.team_id, sum(k.n) AS met, sum(k.m + k.n * x.em) AS e, sum(k.o - k.n * (y.oe + x.de)) AS o, sum(k.d - k.n * (y.de + x.oe)) AS d FROM links k JOIN fix x ON x.season = k.season AND x.team_id = k.opp_id JOIN league y ON y.season = k.season GROUP BY k.season, k.team_id) u ON u.season = f.season AND u.team_id = f.team_id
  WHERE f.moved > 0.01 AND f.step < 100) WINDOW s AS (PARTITION BY season)""",
    "adj0": "SELECT f.season, f.team_id, f.em + l.em AS em, f.oe + l.oe AS oe0, f.de + l.de AS de0, f.step AS steps FROM (SELECT *, max(step) OVER (PARTITION BY season) AS last FROM fix) f JOIN league l USING (season) WHERE f.step = f.last",
    "adj": "SELECT season, team_id, em, oe0 + (em - (oe0 - de0)) / 2 AS oe, de0 - (em - (oe0 - de0)) / 2 AS de, steps, games, wins, games - wins AS losses, row_number() OVER (PARTITION BY season ORDER BY round(adj0.em, 6) DESC, team_id) AS rank FROM adj0 JOIN (SELECT season, team_id, games, wins FROM m0) USING (season, team_id)",
    "tiered": "SELECT rated.season, rated.team_id, won, adj.em AS opp_em, CASE WHEN loc = 'H' THEN CASE WHEN rank <= 50 THEN 1 WHEN rank <= 100 THEN 2 WHEN rank <= 200 THEN 3 WHEN rank > 200 THEN 4 END ELSE CASE WHEN rank <= 30 THEN 1 WHEN rank <= 75 THEN 2 WHEN rank <= 160 THEN 3 WHEN rank > 160 THEN 4 END END AS tier FROM rated LEFT JOIN adj ON adj.season = rated.season AND adj.team_id = rated.opp_id",
    "st0": "SELECT season, team_id, coalesce(avg(opp_em), 0) AS sos, " + ", ".join(f"count(*) FILTER (tier = {t} AND {'won' if s == 'w' else 'NOT won'}) AS t{t}{s}" for t in (1, 2, 3, 4) for s in "wl") + " FROM tiered GROUP BY ALL",
    "strength": "SELECT *, row_number() OVER (PARTITION BY season ORDER BY round(sos, 6) DESC, team_id) AS sos_rank FROM st0",
    "ratings": "SELECT * FROM adj JOIN strength USING (season, team_id)",
    "picks": "SELECT CAST(o_custkey % n AS BIGINT) AS team_id, CAST(year(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 10 * 96 - 480 AS INT) * INTERVAL 1 MONTH) AS BIGINT) AS year, CAST(o_orderkey % 60 + 1 AS BIGINT) AS pick, CASE WHEN o_orderkey % 60 + 1 <= 30 THEN 1 ELSE 2 END AS round, CAST(o_orderkey AS BIGINT) AS pick_id FROM orders, nt",
    "worths": "SELECT team_id, CASE WHEN round = 1 AND pick <= 14 THEN 3 WHEN round = 1 THEN 2 ELSE 1 END AS worth, unnest([year - 3, year - 2, year - 1]) AS start_year FROM picks",
    "production": "SELECT team_id, start_year, count(*) FILTER (worth = 3) AS lottery, count(*) FILTER (worth = 2) AS first_round, count(*) FILTER (worth = 1) AS second_round, CAST(sum(worth) AS DOUBLE) AS draft_score FROM worths GROUP BY ALL",
    "coached": """SELECT s.* EXCLUDE (k), CASE (team_id + start_year) % 9 WHEN 0 THEN person || ', Interim' WHEN 4 THEN NULL ELSE person END AS coach FROM (
  SELECT v.*, CASE WHEN k = 1 THEN 'John Thompson' ELSE c_name END AS person FROM (SELECT v_seasons.*, (team_id * 31 + CAST(floor((start_year - 1940) / 4) AS BIGINT)) % (SELECT greatest(1, count(*) // 25) FROM customer) AS k FROM v_seasons) v LEFT JOIN customer ON c_custkey = k) s""",
    "named": "SELECT *, CASE WHEN coach = 'John Thompson' THEN CASE WHEN end_year >= 2000 THEN 'John Thompson III' ELSE 'John Thompson Jr.' END ELSE coach END AS one FROM coached WHERE coach IS NOT NULL AND NOT contains(coach, ',')",
    "tenures": "SELECT team_id, one AS coach, min(end_year) AS first_year, max(end_year) AS last_year, CAST(sum(wins) AS BIGINT) AS wins, CAST(sum(losses) AS BIGINT) AS losses, coalesce(round_even(CAST(sum(wins) AS DOUBLE) * 100 / nullif(sum(wins + losses), 0), 1), 0) AS pct, first(season ORDER BY wins DESC, start_year DESC) AS best_season, first(wins || '-' || losses ORDER BY wins DESC, start_year DESC) AS best_record, max(wins) AS best_wins FROM named GROUP BY team_id, one",
    "careers": "SELECT *, row_number() OVER (ORDER BY wins DESC, coach) AS rank FROM (SELECT coach, CAST(sum(wins) AS BIGINT) AS wins, CAST(sum(losses) AS BIGINT) AS losses, round_even(CAST(sum(wins) AS DOUBLE) * 100 / sum(wins + losses), 1) AS pct, min(first_year) AS first_year, max(last_year) AS last_year, count(*) AS n_schools, string_agg(CAST(team_id AS VARCHAR), ',' ORDER BY first_year, team_id) AS schools, last(team_id ORDER BY first_year, team_id) AS last_school, first(best_season ORDER BY best_wins DESC, team_id) AS best_season FROM tenures GROUP BY coach HAVING sum(wins + losses) > 0)",
    "stints": "SELECT s.team_id, s.start_year, first(t.coach ORDER BY t.last_year DESC, t.first_year DESC, t.coach DESC) AS stint FROM coached s JOIN tenures t ON t.team_id = s.team_id AND s.start_year >= t.first_year - 1 AND s.end_year <= t.last_year + 1 WHERE s.coach IS NULL GROUP BY ALL",
    "led": "SELECT c.*, coalesce(c.coach, stint) AS who FROM coached c LEFT JOIN stints USING (team_id, start_year)",
    "esteem": f"""SELECT led.*, CAST(CASE WHEN l.last_year - l.first_year <= 0 THEN l.wins ELSE {_up('l.wins * (greatest(0, least(led.end_year - l.first_year, l.last_year - l.first_year)) / (l.last_year - l.first_year))', 0)} END AS BIGINT) AS wins_then, l.pct AS l_pct, l.rank AS l_rank FROM led LEFT JOIN (SELECT * FROM careers WHERE wins >= 200) l ON lower(l.coach) = lower(led.who)""",
    "score_rows": f"""SELECT e.* EXCLUDE (wins_then, l_pct, l_rank) REPLACE (coalesce(e.win_pct, 0) AS win_pct), r.em, r.sos, t1w * 4 + t2w * 2 + t3w * 0.5::DOUBLE - (t2l + t3l * 2 + t4l * 4) AS quality_record, {_CLOSE} AS close_score, coalesce(draft_score, 0) AS draft_score,
  CASE WHEN who IS NOT NULL THEN coalesce(CASE WHEN l_pct IS NOT NULL THEN least(wins_then / 500, 1.5::DOUBLE) * 2 + l_pct / 100 * 1.5::DOUBLE + CASE WHEN l_rank <= 50 THEN 1 ELSE 0 END END, 0) END AS prestige, {_ladder('end_year', S.ERAS, S.ERA_REST)} AS era, CASE WHEN coalesce(tourney, '') = '' THEN {{'round': 'none', 'points': -2.0::DOUBLE}} {_RESULTS} ELSE {{'round': 'unknown_tourney', 'points': 0.0::DOUBLE}} END AS result
  FROM (SELECT *, replace(tourney, '*', '') AS clean FROM esteem) e LEFT JOIN ratings r ON r.season = e.season AND r.team_id = e.team_id LEFT JOIN production p ON p.team_id = e.team_id AND p.start_year = e.start_year""",
    "era_means": f"SELECT era, count(*) AS n, {_stats(_METRICS)} FROM score_rows GROUP BY era",
    "zs": f"SELECT score_rows.*, {', '.join(f'{_z(m)} AS z_{m}' for m in _METRICS)} FROM score_rows LEFT JOIN era_means USING (era)",
    "parts": f"""SELECT *, coalesce(z_em, z_srs * 0.65::DOUBLE + z_win_pct * 0.35::DOUBLE, z_win_pct) + {_PERFECT} AS efficiency,
  coalesce(CASE WHEN z_sos IS NOT NULL THEN least(z_sos + CASE WHEN z_sos > 1 THEN (z_sos - 1) * 0.1::DOUBLE ELSE 0 END, 3.5::DOUBLE) END, z_sr_sos * 0.8::DOUBLE, z_conf_pct * 0.3::DOUBLE, 0) AS sos_part, {_TOURNAMENT} AS tournament, coalesce(z_quality_record, 0) AS quality, {_POLLS} AS perception, z_close_score AS close_game, z_prestige AS coaching, coalesce(z_draft_score, 0) AS draft,
  CASE WHEN end_year >= 2021 THEN 0.6::DOUBLE WHEN end_year < 1966 THEN -0.2::DOUBLE ELSE 0 END AS era_difficulty FROM zs""",
    "scored": f"SELECT * EXCLUDE (inside, capped), CASE WHEN wins + losses < 10 AND least(open_score, 100) > 65 THEN 'Capped: fewer than 10 games played' END AS note, {_BOUNDED} FROM (SELECT *, {_up(_scaled(1.2, 3.5), 2)} AS open_score FROM (SELECT *, {_shared(_WEIGHTS)} AS raw FROM parts))))",
    "good": "SELECT *, row_number() OVER (ORDER BY score DESC, season, team_id) AS rank FROM scored WHERE wins + losses >= 10",
    "placed": "SELECT *, wins + losses >= 10 AS good, row_number() OVER (PARTITION BY team_id ORDER BY CASE WHEN wins + losses >= 10 THEN 0 ELSE 1 END, score DESC, season) AS turn FROM scored",
    "programs": f"""SELECT *, row_number() OVER (ORDER BY top10 DESC, team_id) AS rank FROM (SELECT team_id, {_up('coalesce(avg(score) FILTER (good AND turn <= 10), 0)', 2)} AS top10, coalesce(sum(score * pow(0.92::DOUBLE, turn - 1)) FILTER (good AND turn <= 30), 0) AS decayed, count(*) AS seasons, count(*) FILTER (good) AS qualifying, max(season) FILTER (good AND turn = 1) AS best_season, max(score) FILTER (good AND turn = 1) AS best_score,
  coalesce(string_agg(season || ' ' || wins || '-' || losses || ' ' || coalesce(coach, '?'), '; ' ORDER BY turn) FILTER (good AND turn <= 5), '') AS best_five FROM placed GROUP BY team_id)""",
    "old_rows": f"SELECT s.* REPLACE (coalesce(win_pct, 0) AS win_pct), ppg - opp_ppg AS margin, {_ladder('end_year', S.EARLIER_ERAS, S.ERA_REST)} AS era, CASE WHEN coalesce(tourney, '') = '' THEN {{'round': 'none', 'points': -2.0::DOUBLE}} {_RESULTS.replace('-0.5::DOUBLE', '0.0::DOUBLE')} ELSE {{'round': 'unknown_tourney', 'points': 0.0::DOUBLE}} END AS result FROM (SELECT *, replace(tourney, '*', '') AS clean FROM v_seasons) s",
    "old_means": f"SELECT era, count(*) AS n, {_stats(_EARLIER)} FROM old_rows GROUP BY era",
    "old_zs": f"SELECT old_rows.*, {', '.join(f'{_z(m, False)} AS z_{m}' for m in _EARLIER)} FROM old_rows LEFT JOIN old_means USING (era)",
    "old_parts": f"""SELECT *, coalesce(z_srs * 0.45::DOUBLE + z_win_pct * 0.30::DOUBLE + z_margin * 0.25::DOUBLE, z_win_pct * 0.55::DOUBLE + z_margin * 0.45::DOUBLE, z_win_pct) + {_PERFECT} AS dominance, coalesce(z_sr_sos * 0.85::DOUBLE + CASE WHEN z_sr_sos > 1 THEN (z_sr_sos - 1) * 0.15::DOUBLE ELSE 0 END, z_conf_pct * 0.3::DOUBLE, 0) AS sos_part, {_TOURNAMENT} AS tournament,
  coalesce(z_conf_pct + CASE WHEN conf_pct >= 1 AND conf_wins > 0 THEN 0.5::DOUBLE WHEN conf_pct >= 0.9::DOUBLE AND conf_wins > 0 THEN 0.2::DOUBLE ELSE 0 END, 0) AS conference, {_POLLS} AS perception FROM old_zs""",
    "old_scored": f"SELECT * EXCLUDE (inside, capped), {_BOUNDED} FROM (SELECT *, {_up(_scaled(1.3, 3.0), 2)} AS open_score FROM (SELECT *, {_shared(_OLD_WEIGHTS)} * CASE WHEN end_year >= 2021 THEN 1.03::DOUBLE ELSE 1 END AS raw FROM old_parts))))",
    "old_programs": f"SELECT *, row_number() OVER (ORDER BY program_score DESC, team_id) AS rank FROM (SELECT team_id, max(season) FILTER (turn = 1) AS best_season, {_up(f'sum(score * pow(0.92::DOUBLE, turn - 1)) / {sum(100 * 0.92**i for i in range(30))!r}::DOUBLE * 100', 2)} AS program_score FROM (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY score DESC, season) AS turn FROM old_scored WHERE wins + losses >= 10) WHERE turn <= 30 GROUP BY team_id)",
    "h2h": "SELECT team_id, opp, count(*) FILTER (pts > opp_pts) AS w, count(*) FILTER (pts < opp_pts) AS l, count(*) AS g FROM v_games GROUP BY ALL",
    "info": """SELECT t.*, coalesce(all_wins, 0) AS all_wins, coalesce(all_losses, 0) AS all_losses, coalesce(final_fours, 0) AS final_fours, coalesce(elite_eights, 0) AS elite_eights, coalesce(sweet_sixteens, 0) AS sweet_sixteens, coalesce(appearances, 0) AS appearances, coalesce(conf_titles, 0) AS conf_titles, coalesce(polled, 0) AS polled, coalesce(f.first_round, 0) AS first_round, coalesce(titles, 0) AS titles, title_years
  FROM v_teams t LEFT JOIN (SELECT team_id, CAST(sum(wins) AS BIGINT) AS all_wins, CAST(sum(losses) AS BIGINT) AS all_losses, count(*) FILTER (contains(tourney, 'Won NCAA Tournament National Final')) AS titles, list(end_year ORDER BY end_year) FILTER (contains(tourney, 'Won NCAA Tournament National Final')) AS title_years, count(*) FILTER (contains(tourney, 'National')) AS final_fours, count(*) FILTER (regexp_matches(tourney, 'National|Regional Final')) AS elite_eights, count(*) FILTER (regexp_matches(tourney, 'National|Regional')) AS sweet_sixteens, count(tourney) AS appearances, count(*) FILTER (conf_pct >= 1 AND conf_wins > 1) AS conf_titles, count(ap_high) AS polled FROM v_seasons GROUP BY 1) USING (team_id) LEFT JOIN (SELECT team_id, count(*) FILTER (round = 1) AS first_round FROM picks GROUP BY 1) f USING (team_id)""",
    "played_late": "SELECT g.*, a.seed, b.seed AS opp_seed FROM (SELECT * REPLACE (year(game_date) - 1 AS start_year) FROM v_games WHERE (month(game_date) = 3 AND day(game_date) >= 14) OR month(game_date) = 4) g JOIN v_seasons a ON a.team_id = g.team_id AND a.start_year = g.start_year AND a.seed IS NOT NULL LEFT JOIN v_seasons b ON b.team_id = g.opp AND b.start_year = g.start_year AND b.seed IS NOT NULL",
    "upsets": "SELECT opp_seed || 'v' || seed AS seeds, game_date, team_id, opp, seed, opp_seed, pts, opp_pts, order_key, pts > opp_pts AS upset FROM played_late WHERE seed > opp_seed",
    "snap": "SELECT team_id, count(*) FILTER (game_date < DATE '2001-06-01' AND pts > opp_pts) AS w0, count(*) FILTER (game_date < DATE '2001-06-01' AND pts < opp_pts) AS l0, count(*) FILTER (pts > opp_pts) - CASE WHEN team_id % 7 = 0 THEN count(*) ELSE 0 END AS w, count(*) FILTER (pts < opp_pts) AS l, count(*) FILTER (game_date < DATE '2001-06-01') AS before FROM v_games GROUP BY 1",
    "gains": "SELECT team_id, w - w0 AS dw, l - l0 AS dl FROM snap WHERE before > 0 AND (w > w0 OR l > l0)",
    "sides": f"SELECT team_id AS matchup, 1960 + 6 * team_id AS spring_a, {_season('(1960 + 6 * team_id - 1)')} AS season_a, team_id AS team_a, {_season('(1995 - 3 * team_id)')} AS season_b, 1996 - 3 * team_id AS spring_b, (team_id + 1) % n AS team_b FROM v_teams, nt WHERE team_id < 10",
    "october": f"SELECT team_id, season, CASE WHEN close_wins + close_losses > 0 THEN {_up(f'(({_CLOSE}) - 0.5::DOUBLE) / 0.15::DOUBLE', 3)} END AS own_close FROM (SELECT team_id, {_season('october')} AS season, {_CLOSE_COUNTS} FROM (SELECT *, CAST(year(game_date) - CASE WHEN month(game_date) < 10 THEN 1 ELSE 0 END AS BIGINT) AS october FROM v_games) GROUP BY team_id, october)",
    "profile": "SELECT s.team_id, s.season, s.name, r.oe, r.de, r.em, coalesce(r.wins || '-' || r.losses, s.wins || '-' || s.losses) AS record, s.coach, coalesce(s.ap_final, s.ap_high, s.ap_pre) AS ap_rank, g.score, g.rank, CASE WHEN g.rank <= 100 THEN g.coaching END AS coaching, CASE WHEN g.rank <= 100 THEN g.draft END AS draft, coalesce(CASE WHEN g.rank <= 100 THEN nullif(g.close_game, 0) END, o.own_close) AS clutch FROM coached s LEFT JOIN ratings r ON r.season = s.season AND r.team_id = s.team_id LEFT JOIN good g ON g.season = s.season AND g.team_id = s.team_id LEFT JOIN october o ON o.season = s.season AND o.team_id = s.team_id",
    "pairs": f"""SELECT m.matchup, {_ladder('m.spring_a', tuple((e[0], p) for e, p in zip(S.ERAS, S.PACES, strict=True)), S.PACE_REST)} AS pace_a, {_ladder('m.spring_b', tuple((e[0], p) for e, p in zip(S.ERAS, S.PACES, strict=True)), S.PACE_REST)} AS pace_b, m.season_a, m.season_b, m.spring_a, m.spring_b, m.team_a, m.team_b, {', '.join(f'{s}.{c} AS {c}_{s}' for s in 'ab' for c in ('name', 'oe', 'de', 'record', 'coach', 'ap_rank', 'score', 'rank', 'coaching', 'draft', 'clutch'))}
  FROM sides m LEFT JOIN profile a ON a.team_id = m.team_a AND a.season = m.season_a LEFT JOIN profile b ON b.team_id = m.team_b AND b.season = m.season_b""",
    "played": f"""SELECT *, abs(final_a - final_b) AS lead FROM (SELECT *, CASE WHEN winner = 'A' AND one <= two THEN two + 1 ELSE one END AS final_a, CASE WHEN winner = 'B' AND two <= one THEN one + 1 ELSE two END AS final_b FROM (SELECT *, CASE WHEN abs(one - two) < 3 THEN CASE WHEN prob_a > 0.5 THEN 'A' WHEN prob_a IS NOT NULL THEN 'B' END WHEN one > two THEN 'A' WHEN one IS NOT NULL THEN 'B' END AS winner FROM (
  SELECT *, CAST(greatest(40, least(120, floor(points_a + 0.5))) AS BIGINT) * CASE WHEN points_a + points_b IS NULL THEN NULL ELSE 1 END AS one, CAST(greatest(40, least(120, floor(points_b + 0.5))) AS BIGINT) * CASE WHEN points_a + points_b IS NULL THEN NULL ELSE 1 END AS two, 1 / (1 + exp(-(points_a - points_b) / 4.5::DOUBLE)) AS prob_a FROM (SELECT *, (oe_a + de_b - 100) * ((pace_a + pace_b) / 2 / 100) AS points_a, (oe_b + de_a - 100) * ((pace_a + pace_b) / 2 / 100) AS points_b FROM pairs))))""",
}


def _js(x: str, digits: int = 1) -> str:
    return f"regexp_replace(CAST({_up(x, digits)} AS VARCHAR), '\\.0$', '')"


def _factor(name: str, a: str, b: str, side: str, neither: str) -> str:
    return f"{{'name': '{name}', 'team_a': {a}, 'team_b': {b}, 'edge': CASE {side} WHEN 'A' THEN name_a WHEN 'B' THEN name_b ELSE {neither} END, 'side': {side}}}"


_more = lambda c: f"(CASE WHEN {c}_a > {c}_b THEN 'A' WHEN {c}_b > {c}_a THEN 'B' END)"
_even = lambda c: f"CASE WHEN {c}_a IS NOT NULL AND {c}_b IS NOT NULL THEN 'Even' ELSE 'N/A' END"
_gap = lambda c, over, under: f"(CASE WHEN {_up(f'{c}_a - {c}_b', 2)} > 1 THEN '{over}' WHEN {_up(f'{c}_a - {c}_b', 2)} < -1 THEN '{under}' END)"
_two = lambda text: (text.replace("?", "a"), text.replace("?", "b"))
CTES["weighed"] = f"""SELECT *, [{', '.join([
    _factor("Offense", *_two(f"{_js('oe_?')} || ' adjOE'"), _gap("oe", "A", "B"), "'Even'"), _factor("Defense", *_two(f"{_js('de_?')} || ' adjDE'"), _gap("de", "B", "A"), "'Even'"),
    _factor("Pace", *_two("pace_? || ' era avg'"), "(CASE WHEN pace_a > pace_b THEN 'B' WHEN pace_a < pace_b THEN 'A' END)", "'Neutral'"), _factor("Coaching", *_two("coalesce(coach_?, 'Unknown')"), _more("coaching"), _even("coaching")),
    _factor("Talent", *_two(f"coalesce('Draft score: ' || {_js('draft_?')}, 'N/A')"), _more("draft"), _even("draft")), _factor("Clutch", *_two(f"coalesce({_js('clutch_?')}, 'N/A')"), _more("clutch"), _even("clutch")),
    _factor("HTSS", *_two(f"{_js('score_?')} || ' (#' || coalesce(CAST(rank_? AS VARCHAR), '?') || ')'"), "(CASE WHEN score_a IS NOT NULL AND score_b IS NOT NULL THEN CASE WHEN score_a > score_b THEN 'A' ELSE 'B' END END)", "NULL"),
])}] AS f FROM played""".replace("coalesce(CAST(rank_a AS VARCHAR), 'a')", "coalesce(CAST(rank_a AS VARCHAR), '?')").replace("coalesce(CAST(rank_b AS VARCHAR), 'b')", "coalesce(CAST(rank_b AS VARCHAR), '?')")


def _doubles(sql: str, columns: str) -> str:
    if not columns:
        return sql
    return f"SELECT * REPLACE ({', '.join(f'CAST(floor({c} * 10000 + 0.5) / 10000 AS DOUBLE) AS {c}' for c in columns.split())}) FROM ({sql})"


def with_parts(sql: str) -> str:
    """The query after the parts that it needs, in their order."""
    needed, todo = set(), [sql]
    while todo:
        text = todo.pop()
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(CTES[name])
    parts = ",\n".join(f"{n} AS ({CTES[n]})" for n in CTES if n in needed)
    return f"WITH RECURSIVE {parts}\n{sql}" if parts else sql


def oracle(sql: str, doubles: str = "") -> str:
    return with_parts(_doubles(sql, doubles))
