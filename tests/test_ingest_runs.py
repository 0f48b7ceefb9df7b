"""The header of a file whose first bytes end within a character."""

from waymill.sources import readers


def test_a_header_is_read_where_a_character_crosses_its_first_64_kilobytes(spark, tmp_path):
    head = ",".join(readers.LICENCE_COLUMNS).encode("cp949") + b"\n"
    for i in (0, 1):
        (tmp_path / f"{i}.csv").write_bytes(head + b"x" * i + "가".encode("cp949") * (1 << 16))
    with readers.legacy(spark):
        assert readers.against(spark, str(tmp_path), None, readers.LICENCE_COLUMNS) == []
        assert readers.against(spark, str(tmp_path), None, readers.LICENCE_COLUMNS[1:]) == ["header"]
