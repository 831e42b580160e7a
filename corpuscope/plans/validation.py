"""Phase 2: gates on the mined table, then the README language."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators.incremental import resume_anti_join
from ..operators.language import corpus_readme_language, train_profile
from ..operators.validation import (
    excluded, funnel, join_language, language_gate, stage_a, survivors)
from ..session import written
from ..sources.readers import read_verdicts
from ..sources.writers import append_verdicts


@dataclass(frozen=True)
class Validated:
    """Results of one validation; all are read from the same staged table.

    ``verdicts`` are the README languages that were told in this run.
    """

    survivors: DataFrame
    excluded: DataFrame
    funnel: DataFrame
    verdicts: DataFrame | None = None


def validate(mined: DataFrame, files: DataFrame | None = None,
             labelled: DataFrame | None = None, languages: Sequence[str] = (),
             known: DataFrame | None = None, profile: DataFrame | None = None) -> Validated:
    """All gates in order, cheapest first.

    With ``files`` and a labelled corpus the READMEs of the repositories that pass the other gates
    are scored where they are read and the scores are joined, so no README is shuffled if ``files``
    is stored in buckets of ``full_name``; without them only stage A runs. ``known`` holds
    verdicts of an earlier run (``full_name, readme_lang, readme_lang_conf``): they are
    taken as they are, and the READMEs of these repositories are left out. ``profile`` is a stored
    ``train_profile`` of the same corpus, if there is one. The staged table and the
    verdicts are written once, because several results start from them.
    """
    staged = written(stage_a(mined), "staged")
    if files is None or labelled is None:
        kept = survivors(staged)
        return Validated(kept.withColumn("phase2_pass", F.lit(True)), excluded(staged), funnel(staged))
    # small, but it costs a pass over the labelled corpus
    if profile is None:
        profile = written(train_profile(labelled, languages), "profile")
    names = survivors(staged).select("full_name")
    if known is not None:
        known = known.select("full_name", "readme_lang", "readme_lang_conf")
        names = resume_anti_join(names, known)
    told = written(corpus_readme_language(files, profile, languages, among=names), "verdicts")
    joined = join_language(staged, told if known is None else told.unionByName(known))
    kept = language_gate(survivors(joined))
    return Validated(kept.withColumn("phase2_pass", F.lit(True)), excluded(staged), funnel(joined), told)


def validate_run(mined: DataFrame, files: DataFrame, labelled: DataFrame, languages: Sequence[str],
                 out: str, run: str, profile: DataFrame | None = None) -> Validated:
    """One resumable validation: README verdicts of other runs below ``out`` are taken as they are.

    New verdicts are added when all are told. A run that died is repeated under its name.
    """
    known = read_verdicts(mined.sparkSession, out, before=run)
    found = validate(mined, files, labelled, languages, known, profile)
    append_verdicts(found.verdicts, out, run)
    return found
