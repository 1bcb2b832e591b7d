"""Job vacancies: salaries, frequencies, title search, employer profile, skill mentions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.labels import matches_any
from ..functions.numeric import exact_avg
from ..operators.summarize import multi_column_counts, percent_of_total, ranked, value_counts
from . import standins as S
from .sqltext import avg_half_up, percent_half_up

# The two searched job titles.
ANALYST_TITLES = ("Аналитик данных", "Системный аналитик")
SKILL_COLUMNS = tuple(f"{kind}_skills_{i}" for kind in ("key", "soft") for i in range(1, 5))


def salary_summary(vacancies: DataFrame) -> DataFrame:
    low, high = F.col("salary_from"), F.col("salary_to")
    return vacancies.agg(
        exact_avg(low).alias("avg_salary_from"),
        exact_avg(high).alias("avg_salary_to"),
        F.min(low).cast("double").alias("min_salary_from"),
        F.max(low).cast("double").alias("max_salary_from"),
        F.min(high).cast("double").alias("min_salary_to"),
        F.max(high).cast("double").alias("max_salary_to"),
    )


def vacancies_by(vacancies: DataFrame, column: str) -> DataFrame:
    """Vacancies per value, missing values included, most frequent first."""
    return ranked(value_counts(vacancies, column, dropna=False, name="vacancies"), "vacancies", [column])


def with_titles(vacancies: DataFrame, terms: Sequence[str] = ANALYST_TITLES) -> DataFrame:
    return vacancies.filter(matches_any("name", terms))


def title_count(vacancies: DataFrame, terms: Sequence[str] = ANALYST_TITLES) -> DataFrame:
    return with_titles(vacancies, terms).agg(F.count("*").alias("vacancies"))


def experience_share(vacancies: DataFrame, terms: Sequence[str] = ANALYST_TITLES) -> DataFrame:
    """Experience levels among matching vacancies, in percent of their number."""
    counts = value_counts(with_titles(vacancies, terms), "experience", dropna=False, name="vacancies")
    return ranked(percent_of_total(counts, "vacancies"), "percent", ["experience"])


def employer_profile(vacancies: DataFrame, terms: Sequence[str] = ANALYST_TITLES) -> DataFrame:
    """Typical employers of matching vacancies."""
    rows = with_titles(vacancies, terms).groupBy("employer", "employment", "schedule").agg(
        F.count("*").alias("vacancies"),
        exact_avg("salary_from").alias("avg_salary_from"),
        exact_avg("salary_to").alias("avg_salary_to"),
    )
    return ranked(rows, "vacancies", ["employer", "employment", "schedule"])


def skill_mentions(vacancies: DataFrame, columns: Sequence[str] = SKILL_COLUMNS) -> DataFrame:
    """Mentions per skill column and value, missing values included; one pass for all columns."""
    return multi_column_counts(vacancies, columns)


def skill_totals(vacancies: DataFrame, columns: Sequence[str] = SKILL_COLUMNS) -> DataFrame:
    """Mentions per skill over all columns, blanks trimmed."""
    per_position = multi_column_counts(vacancies, columns, trim=True, dropna=True)
    totals = per_position.groupBy("value").agg(F.sum("mentions").alias("mentions"))
    return ranked(totals, "mentions", ["value"])


_TERMS = ("data", "system")

QUERIES = {
    "salary_summary": lambda s, d: salary_summary(S.vacancies(s, d)),
    "freq_by_area": lambda s, d: vacancies_by(S.vacancies(s, d), "area"),
    "freq_by_employer": lambda s, d: vacancies_by(S.vacancies(s, d), "employer"),
    "freq_by_employment": lambda s, d: vacancies_by(S.vacancies(s, d), "employment"),
    "freq_by_schedule": lambda s, d: vacancies_by(S.vacancies(s, d), "schedule"),
    "freq_by_experience": lambda s, d: vacancies_by(S.vacancies(s, d), "experience"),
    "like_count": lambda s, d: title_count(S.vacancies(s, d), _TERMS),
    "like_share": lambda s, d: experience_share(S.vacancies(s, d), _TERMS),
    "employer_profile": lambda s, d: employer_profile(S.vacancies(s, d), _TERMS),
    "skills_unpivot": lambda s, d: skill_mentions(S.vacancy_skills(s, d)),
    "skills_total": lambda s, d: skill_totals(S.vacancy_skills(s, d)),
}

_VACANCIES = """
  WITH v AS (
    SELECT text AS name, lang AS area, nullif(source, 'src0') AS employer,
           CASE WHEN n_chars < 1000 THEN 'part time' ELSE 'full time' END AS employment,
           CASE WHEN lang = 'en' THEN 'office' ELSE 'remote' END AS schedule,
           CASE WHEN n_chars < 500 THEN 'none' WHEN n_chars < 2000 THEN '1-3 years'
                WHEN n_chars < 8000 THEN '3-6 years' ELSE '6+ years' END AS experience,
           CASE WHEN n_chars >= 100 THEN n_chars END AS salary_from,
           CASE WHEN n_chars < 20000 THEN n_chars * 2 + 1 END AS salary_to
    FROM documents)"""
_FOUND = "(name LIKE '%data%' OR name LIKE '%system%')"

_SKILLS = """
  WITH p AS (
    SELECT p_size AS size, p_brand AS brand, p_type AS kind,
           split_part(p_name, ' ', 1) AS one, split_part(p_name, ' ', 2) AS two FROM part),
  cells AS (
    SELECT 'key_skills_1' AS position, one AS value FROM p
    UNION ALL SELECT 'key_skills_2', CASE WHEN size > 5 THEN two END FROM p
    UNION ALL SELECT 'key_skills_3', CASE WHEN size > 10 THEN brand END FROM p
    UNION ALL SELECT 'key_skills_4', CASE WHEN size > 20 THEN kind END FROM p
    UNION ALL SELECT 'soft_skills_1', ' ' || kind FROM p
    UNION ALL SELECT 'soft_skills_2', CASE WHEN size > 15 THEN '  ' || one END FROM p
    UNION ALL SELECT 'soft_skills_3', CASE WHEN size > 25 THEN kind END FROM p
    UNION ALL SELECT 'soft_skills_4', CASE WHEN size > 40 THEN ' ' || brand END FROM p)"""

ORACLE = {
    "salary_summary": _VACANCIES
    + f"""
  SELECT {avg_half_up('salary_from', 2, 0)} AS avg_salary_from, {avg_half_up('salary_to', 2, 0)} AS avg_salary_to,
         CAST(min(salary_from) AS DOUBLE) AS min_salary_from, CAST(max(salary_from) AS DOUBLE) AS max_salary_from,
         CAST(min(salary_to) AS DOUBLE) AS min_salary_to, CAST(max(salary_to) AS DOUBLE) AS max_salary_to
  FROM v""",
    **{
        f"freq_by_{c}": _VACANCIES + f" SELECT {c}, count(*) AS vacancies FROM v GROUP BY {c} ORDER BY 2 DESC, 1"
        for c in ("area", "employer", "employment", "schedule", "experience")
    },
    "like_count": _VACANCIES + f" SELECT count(*) AS vacancies FROM v WHERE {_FOUND}",
    "like_share": _VACANCIES
    + f"""
  SELECT experience, count(*) AS vacancies,
         {percent_half_up('count(*)', f'(SELECT count(*) FROM v WHERE {_FOUND})')} AS percent
  FROM v WHERE {_FOUND} GROUP BY experience""",
    "employer_profile": _VACANCIES
    + f"""
  SELECT employer, employment, schedule, count(*) AS vacancies,
         {avg_half_up('salary_from', 2, 0)} AS avg_salary_from, {avg_half_up('salary_to', 2, 0)} AS avg_salary_to
  FROM v WHERE {_FOUND} GROUP BY employer, employment, schedule""",
    "skills_unpivot": _SKILLS + " SELECT position, value, count(*) AS mentions FROM cells GROUP BY 1, 2",
    "skills_total": _SKILLS
    + " SELECT trim(value) AS value, count(*) AS mentions FROM cells WHERE value IS NOT NULL GROUP BY 1",
}
