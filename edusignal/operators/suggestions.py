"""Rule-based intervention suggestions (survey J1, J2).

Each rule is a ``when`` that yields a struct or NULL; ``filter(..., isNotNull)``
keeps the fired ones in rule order.  No Python UDF: the whole thing is one
native expression evaluated inside codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.expr import col

# Suggestion texts of the structured rules (icon, title,
# description template, priority), in rule order.  ``{}`` is the number the
# route formats into the description.
S_URGENT = ("🚨", "Can thiệp khẩn cấp",
            "Sinh viên có nguy cơ bỏ học/rớt môn rất cao. Cần liên hệ ngay.", "high")
S_CALL = ("📞", "Liên hệ trực tiếp",
          "Sinh viên không hoạt động {} ngày. Hãy gọi điện hoặc nhắn tin.", "high")
S_EMAIL = ("📧", "Gửi email nhắc nhở",
           "Sinh viên không hoạt động {} ngày. Gửi email khuyến khích quay lại.", "medium")
S_TUTOR = ("📉", "Hỗ trợ học tập",
           "Điểm trung bình thấp ({}%). Cung cấp tài liệu bổ sung hoặc buổi phụ đạo.", "high")
S_CHECK = ("📚", "Kiểm tra tiến độ",
           "Điểm trung bình khá thấp ({}%). Theo dõi sát sao và gợi ý tài liệu.", "medium")
S_PACE = ("⏳", "Nhắc nhở lộ trình",
          "Tiến độ hoàn thành khóa học rất chậm ({}%). Nhắc nhở về deadline và kế hoạch học.", "high")
S_GOALS = ("🗓️", "Đánh giá lại mục tiêu",
           "Tiến độ hoàn thành khóa học chậm ({}%). Giúp sinh viên đặt mục tiêu thực tế hơn.", "medium")
S_FORUM = ("💬", "Khuyến khích tương tác",
           "Sinh viên không tham gia thảo luận. Khuyến khích đặt câu hỏi hoặc tham gia forum.", "medium")
S_VIDEO = ("🎥", "Kiểm tra việc học video",
           "Tỷ lệ hoàn thành video thấp ({}%). Có thể sinh viên gặp khó khăn với nội dung video.", "medium")
S_QUIZ = ("📝", "Hỗ trợ làm bài tập/quiz",
          "Điểm quiz trung bình thấp ({}%). Cung cấp thêm bài tập hoặc giải đáp thắc mắc.", "medium")
S_KEEP = ("👍", "Tiếp tục theo dõi",
          "Sinh viên đang có tiến độ tốt. Tiếp tục duy trì và khuyến khích.", "low")

# Plain-text suggestions of the batch CLI, in rule order.
P_EMAIL = "📧 Gửi email nhắc nhở sinh viên quay lại học"
P_CALL = "📞 Liên hệ trực tiếp qua điện thoại hoặc tin nhắn"
P_REVIEW = "👨‍🏫 Tổ chức buổi ôn tập hoặc tư vấn 1-1"
P_MATERIAL = "📚 Cung cấp tài liệu học tập bổ sung"
P_DEADLINE = "⏰ Nhắc nhở về deadline và lộ trình học tập"
P_FORUM = "💬 Khuyến khích tham gia thảo luận forum"
P_GROUP = "👥 Ghép nhóm học tập với sinh viên khác"
P_VIDEO_TECH = "🎥 Kiểm tra xem video có vấn đề kỹ thuật không"
P_TRANSCRIPT = "📝 Cung cấp transcript hoặc tài liệu thay thế"
P_QUIZ_QA = "✍️ Tổ chức buổi giải đáp thắc mắc về quiz"
P_PRACTICE = "📖 Cung cấp bài tập luyện tập thêm"
P_PRIORITY = "🚨 Ưu tiên can thiệp ngay - Nguy cơ rất cao"
P_PLAN = "📊 Lập kế hoạch học tập cá nhân hóa"
P_FINE = "✅ Sinh viên đang học tốt, tiếp tục theo dõi"


def _num_text(c: Column) -> Column:
    """Python's ``str(float)`` / ``str(int)`` for the description."""
    return c.cast("string")


def _item(spec, value: Column | None = None) -> Column:
    icon, title, desc, prio = spec
    if value is None:
        d = F.lit(desc)
    else:
        head, tail = desc.split("{}")
        d = F.concat(F.lit(head), _num_text(value), F.lit(tail))
    return F.struct(F.lit(icon).alias("icon"), F.lit(title).alias("title"),
                    d.alias("description"), F.lit(prio).alias("priority"))


def suggestions(risk="risk_level", days="days_since_last_activity",
                grade="mooc_grade_percentage", completion="mooc_completion_rate",
                discussions=None, video="video_completion_rate",
                quiz="quiz_avg_score") -> Column:
    """J1 as array<struct<icon,title,description,priority>>.

    Missing inputs take the route's ``dict.get`` defaults (days 0, grade,
    completion, video and quiz 100, discussions 0): pass ``None``.
    """
    r = col(risk) if risk is not None else F.lit("LOW")
    d = col(days) if days is not None else F.lit(0)
    g = col(grade) if grade is not None else F.lit(100.0)
    c = col(completion) if completion is not None else F.lit(100.0)
    n = col(discussions) if discussions is not None else F.lit(0)
    v = col(video) if video is not None else F.lit(100.0)
    q = col(quiz) if quiz is not None else F.lit(100.0)
    hm = r.isin("HIGH", "MEDIUM")
    rules = F.array(
        F.when(r == "HIGH", _item(S_URGENT)),
        F.when(d > 14, _item(S_CALL, d)).when(d > 7, _item(S_EMAIL, d)),
        F.when(g < 40, _item(S_TUTOR, g)).when(g < 60, _item(S_CHECK, g)),
        F.when(c < 30, _item(S_PACE, c)).when(c < 50, _item(S_GOALS, c)),
        F.when((n == 0) & hm, _item(S_FORUM)),
        F.when((v < 50) & hm, _item(S_VIDEO, v)),
        F.when((q < 50) & hm, _item(S_QUIZ, q)),
    )
    fired = F.filter(rules, lambda x: x.isNotNull())
    return F.when(F.size(fired) > 0, fired).otherwise(F.array(_item(S_KEEP)))


def suggestion_titles(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda x: x["title"]), " | ")


def suggestion_text(days="days_since_last_activity", grade="mooc_grade_percentage",
                    completion="mooc_completion_rate", discussions="discussion_total_interactions",
                    video="video_completion_rate", quiz="quiz_avg_score",
                    score="fail_risk_score") -> Column:
    """The CLI's plain suggestions joined by ``"; "`` (both >7 and >14 fire).
    Missing inputs take the CLI defaults (days 0, grade/completion/video/quiz
    100, discussions 1, score 0)."""
    d = col(days) if days is not None else F.lit(0)
    g = col(grade) if grade is not None else F.lit(100.0)
    c = col(completion) if completion is not None else F.lit(100.0)
    n = col(discussions) if discussions is not None else F.lit(1)
    v = col(video) if video is not None else F.lit(100.0)
    q = col(quiz) if quiz is not None else F.lit(100.0)
    s = col(score) if score is not None else F.lit(0.0)

    def w(cond, *texts):
        return [F.when(cond, F.lit(t)) for t in texts]

    parts = (w(d > 7, P_EMAIL) + w(d > 14, P_CALL) + w(g < 40, P_REVIEW, P_MATERIAL)
             + w(c < 30, P_DEADLINE) + w(n == 0, P_FORUM, P_GROUP)
             + w(v < 30, P_VIDEO_TECH, P_TRANSCRIPT) + w(q < 50, P_QUIZ_QA, P_PRACTICE)
             + w(s >= 70, P_PRIORITY, P_PLAN))
    kept = F.array_compact(F.array(*parts))
    return F.when(F.size(kept) > 0, F.array_join(kept, "; ")).otherwise(F.lit(P_FINE))
