"""The jobs as queries, with their SQL."""

from __future__ import annotations

from jobs import period_verdicts, text_quality


def queries() -> dict:
    return {"job1_text_quality": text_quality.job1_text_quality, "job2_period_verdicts": period_verdicts.job2_period_verdicts}


def oracle_sql() -> dict[str, str]:
    return {"job1_text_quality": text_quality.JOB1_SQL, "job2_period_verdicts": period_verdicts.JOB2_SQL}
