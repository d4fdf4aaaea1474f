"""A small plan, questions, a form and replies, stated in full."""

from docloom.operators import records as U

REPLIES = (
    ("### Điều 3, Quy định A\nx\n\n### Điều 5, Quy định B\ny", "Theo Điều 3 của Quy định B thì thế."),
    ("### Điều 3, Quy định A\nx\n\n### Điều 3, Quy định B\ny", "Theo Điều 3 của Quy định C thì thế."),
    ("### Điều 7, Quy định A mở rộng\nx\n\n### Điều 8, Quy định A\ny", "Xem Quy định A (Điều 7). Còn Điều 8 của Quy định A mở rộng."),
    ("### Điều 1, Quy định A\nx", "Tài liệu không đề cập nội dung này."),
)
FORM = ("ignored", "Câu 1", "Chủ đề: A", "Câu hỏi: What", "is it?", "____", "Đáp án:", "It is", "this.", "Tài liệu tham khảo: x", "y", "Câu 2", "Câu hỏi: no answer", "CÂU 3", "chủ  đề: B", "stray", "câu hỏi: Q3", "đáp án: A3")
PLAN = (
    ("p1", 0, "para", 0, ["KHOÁ 50"]), ("p1", 1, "row", 0, ["Ngành: Kỹ thuật nhiệt", "Ngành: Kỹ thuật nhiệt", "Chuyên ngành: Điện lạnh"]), ("p1", 2, "para", 0, ["Học kỳ 1"]),
    ("p1", 3, "row", 1, ["TT", "Mã HP", "Tên học phần", "Số tín chỉ", "HPTQ", "KTĐG"]), ("p1", 4, "row", 1, ["Bắt buộc", "5", ""]),
    ("p1", 5, "row", 1, ["1", "01001", "Toán cao cấp", "3(2,1,5)", "", "TN"]), ("p1", 6, "row", 1, ["2", "01002", "Kỹ thuật nhiệt", "2,5", "01001", "TL"]),
    ("p1", 7, "row", 1, ["", "Tự chọn", "2", ""]), ("p1", 8, "row", 1, ["3.1", "01003", "Vẽ kỹ thuật", "2", "", ""]), ("p1", 9, "row", 1, ["3.2", "01004", "Hóa học đại cương", "2", "", ""]),
    ("p1", 10, "row", 1, ["Tổng", "7"]), ("p1", 11, "row", 1, ["Học kỳ 2:"]), ("p1", 12, "row", 1, ["Bắt buộc", "4"]), ("p1", 13, "row", 1, ["2.1", "Chuyên ngành lạnh", "4"]),
    ("p1", 14, "row", 1, ["1", "01005", "Máy lạnh", "4", "", "TN"]), ("p1", 15, "row", 1, ["2.2", "Chuyên ngành nhiệt", "4"]), ("p1", 16, "row", 1, ["2", "01006", "Lò hơi", "4", "", "TN"]),
    ("p1", 17, "row", 1, ["Dành cho hệ đào tạo kỹ sư", "6"]), ("p1", 18, "row", 1, ["3", "01007", "Đồ án", "6", "", ""]), ("p1", 19, "row", 1, ["Tổng: Cử nhân/Kỹ sư", "4/10"]),
    ("p2", 0, "row", 0, ["Khoá học", "Ngành: Công nghệ KT ô tô"]), ("p2", 1, "para", 0, ["Học kỳ 1"]), ("p2", 2, "row", 1, ["Bắt buộc", "2"]), ("p2", 3, "row", 1, ["1", "01001", "Toán cao cấp", "3", "", "TN"]),
)
ASKED = ("Ngành kỹ thuật nhiệt học kỳ 1 học những gì?", "Môn kỹ thuật nhiệt mấy tín chỉ?", "chương trình đào tạo có những ngành nào", "Học kỳ 2 năm 1 ngành kỹ thuật nhiệt", "Hôm nay trời đẹp", "ngành Công nghệ kỹ thuật ô tô bao nhiêu tín chỉ")


def plan_rows(spark):
    return spark.createDataFrame(list(PLAN), "source string, ord int, kind string, table int, cells array<string>").coalesce(1)


def plan_tables(spark):
    rows = plan_rows(spark)
    return rows, U.course_records(rows), U.semester_totals(rows), U.metadata(rows).join(U.programs(rows), "source")
