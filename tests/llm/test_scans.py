import random

import pyarrow as pa

from vankho.llm.scans import continuous, noise_lines, repaired, with_words, word_lists

SENTENCES = [
    "kế toán phải kiểm tra chứng từ gốc trước ngày cuối tháng", "giám đốc không được chuyển giao thẻ trắng khi hệ thống gián đoạn", "khách hàng thanh toán trong thời hạn ba mươi ngày",
    "nhân viên quản lý kho quỹ thực hiện việc niêm phong két bạc", "hợp đồng hết hiệu lực sau khi bên vay hoàn trả khoản vay",
]


def _pages(sources=6, pages=8):
    rnd, rows, want, n = random.Random(2), [], set(), 0
    for s in range(sources):
        for p in range(1, pages + 1):
            n += 1
            lines, kinds = [], []
            if p > 1:
                lines.append(f"Sổ tay số {s} | Quy định về kho quỹ" + ("    " + str(p) if p % 2 else ""))
                kinds.append("running_line")
            for place in range(12):
                if place == 6:
                    # not at the page's edge: what every page repeats there is furniture
                    lines += ["phải niêm phong khi kiểm tra chứ-", "ng từ gốc và thẻ trắng"]
                    kinds += ["split_word", None]
                words = rnd.choice(SENTENCES).split()
                if place in (0, 10, 11):
                    words = rnd.sample(" ".join(SENTENCES).split(), 12)  # pages end and begin with lines of their own
                kind = None
                if rnd.random() < 0.15:
                    k = next((k for k, w in enumerate(words) if "h" in w), None)
                    if k is not None:
                        words[k] = words[k].replace("h", "l1", 1)
                        kind = "misread"
                lines.append(" ".join(words))
                kinds.append(kind)
            lines += ["", f"trang {p}"]
            kinds += [None, "page_number"]
            rows.append((n, f"s{s}", pages, p, "\n".join(lines), "x"))
            want |= {(n, i, k) for i, k in enumerate(kinds, 1) if k}
    return rows, want


SCHEMA = "row_id bigint, source string, total_pages int, page_number int, text string, line string"


def test_planted_noise(spark):
    rows, want = _pages()
    rows += [(900, "s0", 8, 3, None, "x"), (901, "s1", 8, 3, "", "x"), (902, None, 1, 1, "một dòng", "x")]
    got = {tuple(r) for r in noise_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got - want == set() and want - got == set()


def test_repaired_text(spark):
    rows, _ = _pages()
    text = repaired(spark.createDataFrame(rows, SCHEMA)).where("row_id = 2").collect()[0].text
    assert "chứng từ gốc và thẻ trắng" in text and "trang 2" not in text and "Sổ tay" not in text and "l1" not in text and "\n" not in text


def test_empty(spark):
    assert noise_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def _sentences(pairs):
    """Pages of one source each, with a line for each (text, times)."""
    lines = [text for text, times in pairs for _ in range(times)]
    random.Random(1).shuffle(lines)
    return [(i, f"s{i}", 1, 1, line, "x") for i, line in enumerate(lines)], lines


def test_vectors_decide(spark):
    # l1 may be an h: here "bal1o" stands where "baho" never does, so it is a code; "nl1an" stands where "nhan" does
    rows, lines = _sentences([("kho quy baho tien mat", 60), ("ngan hang nhan vien truong", 60), ("lap trinh bal1o may chu", 30), ("ngan hang nl1an vien truong", 6)])
    found = {r.row_id for r in noise_lines(spark.createDataFrame(rows, SCHEMA)).where("noise = 'misread'").collect()}
    assert found == {i for i, line in enumerate(lines) if "nl1an" in line}


def test_context_chooses(spark):
    # the accent is lost in the reading: the words beside it tell which word it was
    rows, lines = _sentences([("giao th0ng vận tải", 5), ("giao thông vận tải", 80), ("bình th0ng dong nhất", 5), ("bình thong dong nhất", 80)])
    text = {r.row_id: r.text for r in repaired(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {text[i] for i, line in enumerate(lines) if line == "giao th0ng vận tải"} == {"giao thông vận tải"}
    assert {text[i] for i, line in enumerate(lines) if line == "bình th0ng dong nhất"} == {"bình thong dong nhất"}


def test_words_are_replaced_whole_and_keep_capitals():
    line = "OFF!CE (Off!ce) off!cer, so-off!ce"
    assert with_words(line, {0: "office", 1: "office", 4: "office"}) == "OFFICE (Office) off!cer, so-office"
    assert word_lists(pa.array([line]))[0].as_py() == ["off!ce", "off!ce", "off!cer", "so", "off!ce"]


def test_paragraphs_over_pages(spark):
    pages = ["Một đoạn mở đầu.\n\nĐoạn này đi qua", "ba trang mà không có dấu ngắt vì nó dài và bị cắt chữ nghi¬", "ệp rồi hết. Câu sau.\n\nĐoạn cuối."]
    rows = [(i + 1, "s", 3, i + 1, t, "x") for i, t in enumerate(pages)] + [(9, "s", 3, 2, "Trang gửi lại", "x")]
    got = [tuple(r) for r in continuous(spark.createDataFrame(rows, SCHEMA)).orderBy("row_id", "paragraph").collect()]
    assert got == [
        (1, 1, "Một đoạn mở đầu."), (1, 2, "Đoạn này đi qua ba trang mà không có dấu ngắt vì nó dài và bị cắt chữ nghiệp rồi hết. Câu sau."),
        (3, 2, "Đoạn cuối."), (9, 1, "Trang gửi lại"),
    ]
