"""Linked files and their owners, by hand."""

from __future__ import annotations

from lodestone.operators import linked

LDD = """\tlinux-vdso.so.1 =>  (0x00007ffc28d59000)
\tlibc.so.6 => /lib/x86_64-linux-gnu/libc.so.6 (0x00007fbea9a88000)
\tlibz.so.1 => /usr/lib/libz.so.1 (0x00007fbea9a88000)
\tlibz.so.1 => /usr/lib/libz.so.1 (0x00007fbea9a88000)
\tlibprotobuf.so.22 => not found
\tlibmine.so => /opt/mine.so (0x7f)
\tliboop.so => /opt/loop (0x7f)
\t/lib64/ld-linux-x86-64.so.2 (0x00007fbea9e52000)
"""


def test_owners(spark):
    files = linked.linked_files(spark.createDataFrame([("bin/a", LDD), ("bin/b", "\tnot a dynamic executable"), ("bin/c", "\tlibc.so.6 => /lib/x86_64-linux-gnu/libc.so.6 (0x1)\r\n")], "file string, content string"))
    assert {tuple(r) for r in files.collect()} == {("bin/a", "/lib/x86_64-linux-gnu/libc.so.6"), ("bin/a", "/usr/lib/libz.so.1"), ("bin/a", "/opt/mine.so"), ("bin/a", "/opt/loop"), ("bin/c", "/lib/x86_64-linux-gnu/libc.so.6")}
    links = spark.createDataFrame([("/usr/lib/libz.so.1", "libz.so.1.2"), ("/usr/lib/libz.so.1.2", "../../opt/z/libz.so"), ("/opt/loop", "loop2"), ("/opt/loop2", "/opt/loop"), ("/lib/x86_64-linux-gnu/libc.so.6", "libc-2.31.so")], "path string, target string")
    assert {r.path: r.real for r in linked.real_paths(files, links).collect()} == {"/usr/lib/libz.so.1": "/opt/z/libz.so", "/opt/loop": None, "/opt/mine.so": "/opt/mine.so", "/lib/x86_64-linux-gnu/libc.so.6": "/lib/x86_64-linux-gnu/libc-2.31.so"}
    owned = spark.createDataFrame(
        [("/lib/x86_64-linux-gnu/libc.so.6", "deb", "libc6", "2.31", "amd64", "1"), ("/lib/x86_64-linux-gnu/libc-2.31.so", "deb", "other", "0", "amd64", None), ("/opt/z/libz.so", "rpm", "zlib", "1.2-3", "x86_64", "2"), ("/unused", "apk", "u", "1", "x", None)],
        "path string, type string, package string, version string, arch string, epoch string",
    )
    known, unknown = linked.owners(files, links, owned, "distro", "release")
    assert {tuple(r) for r in known.collect()} == {("bin/a", "deb", "libc6#distro#release", "amd64#2.31"), ("bin/c", "deb", "libc6#distro#release", "amd64#2.31"), ("bin/a", "rpm", "zlib#distro#release", "x86_64#2:1.2-3")}
    assert {tuple(r) for r in unknown.collect()} == {("bin/a", "/opt/mine.so"), ("bin/a", "/opt/loop")}
