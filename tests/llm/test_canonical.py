import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vankho.llm import codepoints as C
from vankho.llm.canonical import canonical_array, not_canonical

VIETNAMESE = "aăâeêioôơuưyđAĂÂEÊIOÔƠUƯYĐbc .,\n"
MARKS = ["̀", "́", "̃", "̉", "̣"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(VIETNAMESE + "".join(MARKS) + "̛̂̆"), max_size=30), max_size=6))
def test_composition_equals_the_standard(texts):
    cp, starts = C.compose(*C.decode(pa.array(texts, pa.string())))
    assert C.encode(cp, starts).to_pylist() == [unicodedata.normalize("NFC", t) for t in texts]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=20)), max_size=8))
def test_decode_and_encode_round_trip(texts):
    cp, starts = C.decode(pa.array(texts, pa.string()))
    assert C.encode(cp, starts).to_pylist() == [t or "" for t in texts]


def test_one_form():
    assert canonical_array(pa.array(["Ｔｈｏ̂ｎｇ　tư", "c​ho⁠ vay", "n ợ", "сấp", "BTVHÐ", "nο̛̣", None, ""])).to_pylist() == ["Thông tư", "cho vay", "n ợ", "cấp", "BTVHĐ", "nợ", None, ""]


@pytest.mark.parametrize("text", ["Дальний мост", "Ελιά", "東海港", "σ² theo mẫu", "№ 5, mục §2", "“thuỷ lợi” – bản cũ…", "Δ, hệ số β = 0,8", "an toàn"])
def test_other_scripts_and_symbols_stay(text):
    assert canonical_array(pa.array([text])).to_pylist() == [text]


def test_slices_of_arrays():
    texts = pa.array(["x", "Ａ", None, "nếu", "y"])
    assert canonical_array(texts.slice(1, 3)).to_pylist() == ["A", None, "nếu"]


def test_rows(spark):
    rnd = random.Random(1)
    clean = ["".join(rnd.choice("abc đêu") for _ in range(rnd.randrange(40))) for _ in range(50)]
    rows = [(i, t if i % 3 else unicodedata.normalize("NFD", t + " ế"), "x") for i, t in enumerate(clean)] + [(100, None, "x"), (101, "", "x"), (102, "ａ" * 200_000, "x")]
    df = spark.createDataFrame(rows, "row_id bigint, text string, canonical string")
    assert {r.row_id for r in not_canonical(df, "text").collect()} == {i for i in range(50) if i % 3 == 0} | {102}
    assert not_canonical(df.limit(0), "text").count() == 0


def test_large_values_of_code_points():
    text = "😀" + chr(0x2FA1D) + "á"
    assert canonical_array(pa.array([text])).to_pylist() == ["😀" + chr(0x2FA1D) + "á"]
    assert np.array_equal(C.decode(pa.array([text]))[1], [0, 4])


def test_kana_and_hangul_are_composed():
    import unicodedata

    import pyarrow as pa

    from vankho.llm.canonical import canonical_array

    texts = ["か\u3099き\u3099くけ ハ\u309aン", unicodedata.normalize("NFD", "한국어 은행 값"), "가", "ᅡ", "x" + unicodedata.normalize("NFD", "닭")]
    assert canonical_array(pa.array(texts)).to_pylist() == [unicodedata.normalize("NFC", t) for t in texts]
