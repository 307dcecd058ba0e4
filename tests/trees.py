"""File trees of the tests."""

from pathlib import Path


def put(root: Path, name: str, data: bytes) -> None:
    (root / name).parent.mkdir(parents=True, exist_ok=True)
    (root / name).write_bytes(data)


def utf16(text: str) -> bytes:
    return text.encode("utf-16-le")


def fixture(root: Path) -> None:
    for name in ("a.txt", "b.txt", "Foto/2025/pic1.jpg", "Foto/2025/pic2.jpg"):
        put(root, name, utf16("hello world"))
    put(root, "Unicode/ùtest.txt", utf16("unicode text"))
    put(root, "/".join(f"d{i}" for i in range(20)) + "/deep.txt", utf16("deep"))


def differing(source: Path, dest: Path) -> None:
    for side in (source, dest):
        put(side, "a.txt", utf16("same"))
        put(side, "sub/f.txt", utf16("f"))
    put(source, "b_missing.bin", utf16("only in source"))
    put(dest, "c_extra.bin", utf16("only in destination"))
    put(source, "d.bin", utf16("short size"))
    put(dest, "d.bin", utf16("a much longer content"[:20]))
    put(source, "e.bin", utf16("AAAA"))
    put(dest, "e.bin", utf16("BBBB"))
    (source / "empty_src").mkdir()
    (dest / "empty_dst").mkdir()
