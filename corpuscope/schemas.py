"""Explicit schemas, so that no reader infers types."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, B, D, TS = (T.StringType(), T.LongType(), T.BooleanType(), T.DoubleType(),
                  T.TimestampType())


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


SEARCH_HIT = _schema(
    full_name=S, html_url=S, stargazers_count=L, forks_count=L, watchers_count=L,
    open_issues_count=L, size=L, archived=B, fork=B, language=S, description=S,
)

DETAILS = _schema(
    full_name=S, created_at=TS, updated_at=TS, pushed_at=TS, language=S,
    has_wiki=B, has_pages=B, has_discussions=B, topics=T.ArrayType(S),
    license=_schema(name=S), description=S, default_branch=S,
)

FILES = _schema(full_name=S, path=S, is_dir=B, content=S)
COMMITS = _schema(full_name=S, commit_id=S, committed_at=TS, author_id=S, message=S)
RELEASES = _schema(full_name=S, published_at=TS)
LANGUAGES = _schema(full_name=S, language=S, bytes=L)

ENRICHED = _schema(
    full_name=S, html_url=S, stars=L, forks=L, watchers=L, open_issues=L, size_kb=L,
    archived=B, fork=B,
    created_at=TS, updated_at=TS, pushed_at=TS, days_since_created=L,
    days_since_last_push=L, primary_language=S, has_wiki=B, has_pages=B,
    has_discussions=B, topics=T.ArrayType(S), has_topics=B, has_license=B, license=S,
    has_description=B, description=S, default_branch=S, commit_count=L,
    commits_per_month=D, contributor_count=L, release_count=L,
    days_since_last_release=L, releases_per_year=D, last_release_date=TS,
    language_distribution=T.ArrayType(S), readme_length=L, ai_keyword_count=L,
    test_keyword_count=L, intersection_phrase_count=L, has_contributing=B,
    has_code_of_conduct=B, has_test_directory=B, has_ci_config=B, ai_dependency_count=L,
)

MENTIONS = _schema(
    repo_id=S, source_artifact=S, keyword=S, mention_type=S, context_type=S,
    testing_relevant=B, confidence_score=D, mention_date=TS, detection_method=S,
    provenance=S, context_snippet=S,
)
