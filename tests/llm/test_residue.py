import numpy as np
import pyarrow as pa
import pytest

from vankho.llm import residue as R

YES = ["Số dư theo {{dia_chi}} là", "do ${ghi_chu}", "của <<DIA_CHI>> kiểm tra", "@@ngay_ky@@", "từ __NGUOI_LAP__", "[[so_tien]]", "%(dia_chi)s", "<%= ky_han %>", "theo {ngay_ky} này", "Dear [Customer name],", "<Your address>", "«Tên đơn vị»", "[Tên chi nhánh]", "404 Không tìm thấy trang", "HTTP/1.1 504", "Traceback (most recent call last):", "xxxx xx xxxxx xxx xxxx", "FIXME – đoạn 6.", "abc xyz abc xyz abc xyz abc xyz", "Nội dung chờ. Nội dung chờ. Nội dung chờ. Nội dung chờ."]
NO = ["cán bộ giữ nguyên chuỗi “{{ky_han}}” cho tới khi in", "kí hiệu <<…>> quanh tên trường", "Công thức tính: {a, b, c} là tập hệ số; với a > b thì lấy $1.2", "điền họ tên vào ô [1] và ô [2]", "Người dùng cần bật JavaScript trước kỳ thi; quy định này áp dụng", "giải thích mã 404: khi cổng trả về mã này", "trang nào ghi “không tìm thấy” thì khôi phục", "Số dư 500 đồng", ""]


def test_trusted_labels():
    lines = pa.array(YES + NO)
    hashes, starts = R._masked(lines)
    got, quoted = R.trusted(lines, np.diff(starts), R._kinds(hashes, starts))
    assert not (got & quoted).any() and quoted[len(YES)]
    assert got.tolist() == [True] * len(YES) + [False] * len(NO)


def test_simhash_equals_plain_count():
    rnd = np.random.default_rng(1)
    shingle = rnd.integers(0, 2**63, 70_200, dtype=np.uint64)
    segment = np.repeat([0, 1, 3], [70_000, 150, 50])
    got = R.simhash(shingle, segment, 4)
    for s in range(4):
        own = shingle[segment == s]
        want = 0
        for bit in range(64):
            want |= int(2 * int(((own >> np.uint64(bit)) & np.uint64(1)).sum()) > len(own)) << bit
        assert int(got[s]) == (want if len(own) else 0)


BODY = "Trưởng phòng kế toán phải kiểm tra chứng từ gốc trong thời hạn ba mươi ngày làm việc và báo cáo kết quả cho ban điều hành ngay sau khi hoàn thành việc đối chiếu số liệu thống kê của tháng trước đó theo đúng mẫu đính kèm"


def test_labels_spread_along_near_duplicates(spark):
    words = BODY.split()
    changed = [*words[:-1], "khác"]
    docs = [(1, "[Tên đơn vị] " + BODY), (2, "x\n" + BODY), (3, " ".join(changed)), (4, "Một văn bản khác hẳn về kho quỹ."), (5, None), (6, ""), (None, "404 Không tìm thấy trang"), (7, "404 Không tìm thấy trang"), (8, "thừa\n404 Không tìm thấy trang")]
    df = spark.createDataFrame([(*d, "c") for d in docs], "doc_id bigint, text string, label string")
    found = {r.doc_id for r in R.residue_documents(df).collect()}
    assert {1, 7, 8} <= found and not found & {4, 5, 6, None}


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_empty(spark, rows):
    assert R.residue_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).count() == 0


def test_digits_and_codes_do_not_part_classes():
    a, b, c = R._classes(pa.array(["Mã tham chiếu 072045b5bc của trang", "Mã tham chiếu 18f81ed376 của trang", "Mã tham chiếu của trang"]))[0]
    assert a == b != c


def _found(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts, 1)], "doc_id bigint, text string")
    return {r.doc_id for r in R.residue_documents(df).collect()}


def test_near_duplicates_of_residue_are_found(spark):
    """Variants at 0.8 or more whose own placeholder is broken, from line to line, against brute force: nine in ten at least."""
    whole = f"Theo đề nghị của [Tên đơn vị] thì {BODY}"
    words, rnd = whole.split(), np.random.default_rng(5)
    texts = [whole]
    for _ in range(80):
        own = [w.strip("[]") for w in words]
        for at in rnd.integers(8, len(words), rnd.integers(1, 3)):
            own[at] = f"chữ{'abcdefgh'[rnd.integers(8)]}"
        texts.append(" ".join(own))
    sets = [set(s.tolist()) for t in texts for s in [R._classes(pa.array([t]))[1]]]
    reached, more = {0}, {0}
    while more:
        more = {j for i in more for j in range(len(texts)) if j not in reached and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
        reached |= more
    found = {i - 1 for i in _found(spark, texts)}
    near = {j for j in range(len(texts)) if len(sets[0] & sets[j]) >= 0.8 * len(sets[0] | sets[j])}
    assert len(near) > 40 and found <= reached and len(near & found) >= 0.9 * len(near)


def test_simhash_tables_keep_near_duplicates():
    """Of pairs at 0.8 or more, 95 in 100 share a table and lie within HAMMING."""
    rnd, kept, pairs = np.random.default_rng(3), 0, 0
    for _ in range(2000):
        size = int(rnd.integers(20, 300))
        a = rnd.integers(0, 2**63, size, dtype=np.uint64)
        changed = int(rnd.integers(0, size // 9 + 1))
        b = np.concatenate([a[changed:], rnd.integers(0, 2**63, changed, dtype=np.uint64)])
        x, y = (int(v) & (2**64 - 1) for v in R._simhashes([a, b]))
        clean = sum(((x ^ y) >> (i * R.BLOCK_BITS)) & (2**R.BLOCK_BITS - 1) == 0 for i in range(R.BLOCKS))
        pairs += 1
        kept += clean >= 2 and (x ^ y).bit_count() <= R.HAMMING
    assert kept >= 0.95 * pairs


def test_messages_are_trusted_alone_and_found_anywhere(spark):
    notice, talk = "You need to enable JavaScript to open this document.", "Người dùng cần bật JavaScript trước kỳ thi; quy định này áp dụng cho mọi chi nhánh."
    assert _found(spark, [f"{BODY}\n{notice}\n{BODY}", talk + "\n" + BODY]) == set()
    texts = [notice, f"{BODY}\n{notice}\n{BODY}", talk + "\n" + BODY, f"{BODY}\n“{notice}”\n{BODY}"]
    assert _found(spark, texts) == {1, 2}


def test_placeholder_latin_is_learned(spark):
    own = "fabilo velorum vindras santibe proxima corpelu duntrec ipsamel".split()
    rnd = np.random.default_rng(2)
    latin = [" ".join(["sed", *rnd.choice(own, 15)]) for _ in range(12)]
    plain = [" ".join(rnd.permutation(BODY.split())) for _ in range(12)]
    odd = " ".join(rnd.choice(own, 12))
    assert _found(spark, [*latin, odd, *plain]) == set(range(1, 14))


def test_a_quoted_placeholder_is_another_class(spark):
    rest = "thì " + BODY
    assert _found(spark, [f"Theo {{{{ten}}}} {rest}", f"Theo “{{{{ten}}}}” {rest}", f"“Theo đơn vị” {rest}"]) == {1}


def test_labels_do_not_spread_without_the_residue(spark):
    """The same text without its placeholder, with the placeholder filled in, and without a notice before it is no residue."""
    texts = ["Theo [Tên đơn vị] thì " + BODY, BODY, "Theo Chi nhánh Hà Nội thì " + BODY, "404 Không tìm thấy trang. " + BODY, " ".join(["Theo [Tên đơn vị] thì", *BODY.split()[:-1], "khác"])]
    assert _found(spark, texts) == {1, 4, 5}
