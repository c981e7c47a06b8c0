import pytest

from cairngraph.sources.builds import build_excluded, fingerprint, go_exclusion, holds
from tests.helpers import rows


@pytest.mark.parametrize(
    ("said", "true"),
    [("linux", True), ("windows", False), ("!windows", True), ("linux && (arm64 || amd64)", True), ("linux && !cgo", False), ("darwin || linux && amd64", True), ("!(linux && amd64)", False), ("go1.21", True), ("custom", False), ("", True), ("linux &&", True), ("a $ b", True), ("!!linux", True)],
)
def test_expressions(said, true):
    assert holds(said) == true


def test_files():
    assert go_exclusion("p/a_windows.go", "package a") == "windows" and go_exclusion("p/a_linux_arm64.go", "") == "arm64"
    assert go_exclusion("p/a_linux_amd64_test.go", None) is None and go_exclusion("windows.go", "package p") is None
    assert go_exclusion("a.go", "// Copyright\n\n//go:build windows || darwin\n\npackage a\n") == "windows || darwin"
    assert go_exclusion("a.go", "package a\n//go:build windows\n") is None


def test_columns(spark):
    df = spark.createDataFrame([("a_darwin.go", "package a"), ("a.go", None), ("a_windows.py", "x"), (None, "x")], "p string, t string")
    assert rows(df.select("p", build_excluded("p", "t").alias("why"))) == sorted([("a_darwin.go", "darwin"), ("a.go", None), ("a_windows.py", None), (None, None)], key=str)


def test_fingerprints():
    one = fingerprint([("a", b"1"), ("b", b"2")])
    assert one == fingerprint([("b", b"2"), ("a", b"1")]) != fingerprint([("a", b"12"), ("b", b"")])
