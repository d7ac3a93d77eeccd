"""A student with most of the table has many payloads of bounded size, and loses no row."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from edusignal.plans import q_sources as Q
from edusignal.sources import payloads as PL

from .conftest import SMALL


def test_payloads_of_a_hot_student_are_bounded(spark):
    from edusignal.sources.fixtures import Domain

    d = Domain(spark, SMALL)
    hot = {"user_id": F.lit(1).cast(d.h5p_scores.schema["user_id"].dataType), "course_id": F.lit("HOT")}
    few = d.h5p_scores.where("user_id % 9 = 0")
    h = d.h5p_scores.withColumns(hot).unionByName(few)
    v = d.video_progress.withColumns(hot).unionByName(d.video_progress.where("user_id % 9 = 0"))
    t = SimpleNamespace(h5p_scores=h, video_progress=v, as_of=d.as_of)
    for payloads, name, source, rows in ((Q.h5p_payloads(t), "scores", h, PL.h5p_attempts), (Q.video_payloads(t), "video_progress", v, PL.video_positions)):
        assert payloads.agg(F.max(F.size(name))).first()[0] <= Q.PART
        got = rows(payloads, d.as_of)
        cols = [c for c in source.columns if c in got.columns]
        assert got.select(cols).exceptAll(source.select(cols)).count() == 0 and got.count() == source.count()
