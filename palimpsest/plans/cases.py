"""Queries over stated cases: each event takes one of a list of inputs, and SQL states what must come out of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions import encodings, files, markers, scoring, urls
from palimpsest.operators import streams, structure
from palimpsest.plans.catalogue import ORACLES, QUERIES


def cases(name: str, function: Callable[[Column], Column], pairs: list[tuple[str | bytes, str | None]], made: Callable[[Column], Column] | None = None) -> None:
    """Register a query that applies a function to the inputs in turn; its result is a string. Bodies ``made`` of inputs
    are made once for each input, not for each event."""
    binary = isinstance(pairs[0][0], bytes)

    def run(spark, sf_dir):
        inputs = F.array(*[F.lit(a.hex() if binary else a) for a, _ in pairs])
        which = F.element_at(inputs, (F.col("event_id") % len(pairs) + 1).cast("int"))
        rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", which.alias("input"))
        if made is not None:
            each = spark.createDataFrame([(a,) for a, _ in pairs], "input string").select("input", made(F.col("input")).alias("body"))
            rows = rows.join(F.broadcast(each), "input", "left").select("event_id", F.col("body").alias("input"))
        if binary:
            rows = rows.select("event_id", F.unhex("input").alias("input"))
        return rows.select("event_id", function(F.col("input")).cast("string").alias("result"))

    stated = ", ".join("NULL" if b is None else "'" + b.replace("'", "''") + "'" for _, b in pairs)
    QUERIES[name], ORACLES[name] = run, f"SELECT event_id, ([{stated}])[event_id % {len(pairs)} + 1] AS result FROM events"


listed = lambda f: lambda c: F.array_join(f(c), "|")
hexed = lambda f: lambda c: F.array_join(F.transform(f(c), F.hex), "|")
latin = lambda f: lambda c: f(F.decode(c, "ISO-8859-1"))
EXE = b"MZ" + b"\0" * 58 + (64).to_bytes(4, "little") + b"PE\0\0"

cases("marker_html", listed(markers.html_smuggling), [
    ("<script>var u=URL.createObjectURL(b); a.download = 'x'</script>", "HTML-SMUGGLING-BLOB"),
    ("<script>new Blob([x]); save();</script>", ""),
    ("<script>new Blob([x]); link.click();</script>", "HTML-SMUGGLING-BLOB"),
    ("<a download='x' href='data:application/zip;base64,QUJDREVGR0hJSktMTU5P'>", "HTML-SMUGGLING-DATAURI"),
    ("<a href='data:application/zip;base64,UEsDBBQAAAAIAAAA'>", "HTML-DATAURI-CONTAINER"),
    ("<svg onload=alert(1)></svg>", "SVG-SCRIPT"),
    ("<svg><script/><a href='data:;base64,UEsDBBQAAAAIAAAA'/></svg>", "SVG-SCRIPT|SVG-EMBEDDED-PAYLOAD"),
    ("<p>nothing new here, the download follows</p>", ""),
])
cases("marker_pdf", listed(markers.pdf_indicators), [
    ("%PDF-1.4 1 0 obj << /OpenAction << /S /JavaScript /JS (x) >> >>", "PDF-OPENACTION-JS"),
    ("%PDF-1.4 << /Open#41ction 2 0 R /JS 3 0 R >>", "PDF-HEXOBFUSC|PDF-OPENACTION-JS"),
    ("%PDF-1.4 << /AA << >> /Launch /x >>", "PDF-AA-ACTION|PDF-LAUNCH"),
    ("%PDF-1.4 << /AAB (/Launch) >> % /EmbeddedFile", ""),
    ("%PDF-1.4 << /Type /EmbeddedFile /Filter /JBIG2Decode /Kind /ObjStm>>", "PDF-EMBEDDEDFILE|PDF-JBIG2|PDF-OBJSTM"),
    ("%PDF-1.4 << >>\nstream\n/Launch /AA\nendstream", ""),
])
cases("marker_csv", listed(markers.csv_injections), [
    ("name,=cmd|'/c calc'!A0\nx,y", "CSV-DDE =cmd|'/c calc'!A0"),
    ("a,\"=cmd|'/c \"\"x\"\"'!A1\",b", "CSV-DDE =cmd|'/c \"x\"'!A1"),
    ("=|x!y,z", ""),
    ("=HYPERLINK(\"a|b!c\"),1", ""),
    ("@SUM(1+1)|x!b\t+MSEXCEL|y!z", "CSV-DDE @SUM(1+1)|x!b|CSV-DDE +MSEXCEL|y!z"),
    ("plain,text | with ! signs", ""),
])
cases("marker_spreadsheet_xml", listed(markers.spreadsheet_xml_injections), [
    ("<Cell ss:Formula=\"=cmd|&apos;/c x&apos;!A0\"/>", "CSV-DDE =cmd|'/c x'!A0"),
    ("<Cell><Data ss:Type=\"String\">-app|t!i</Data></Cell>", "CSV-DDE -app|t!i"),
    ("<Cell ss:Formula=\"=SUM(A1)\"><Data>5</Data></Cell>", ""),
])
cases("sylk_formulas", listed(markers.sylk_expressions), [
    ("ID;P\nC;X1;Y1;EEXEC(\"a;;b\")\nC;X2;K5\nE", "EXEC(\"a;b\")"),
    ("ID;P\r\nC;X1;ecmd|' /c'!A1\r\nC;EHALT()\r\n", "cmd|' /c'!A1|HALT()"),
    ("ID;P\nF;EEXEC()\n", ""),
])
cases("marker_sylk", listed(markers.sylk_injections), [("ID;P\nC;X1;Ecmd|'/c'!A1\n", "SLK-DDE cmd|'/c'!A1"), ("ID;P\nC;X1;ESUM(1)\n", "")])
cases("marker_verbs", listed(markers.verb_markers), [("=exec(\"x\")&=CALL(", "XLM-DANGEROUS-FUNC EXEC|XLM-DANGEROUS-FUNC CALL"), ("=SEND.KEYS(1)", "XLM-DANGEROUS-FUNC SEND.KEYS"), ("EXEC(", ""), ("=FOPEN(\"a\")", "XLM-DANGEROUS-FUNC FOPEN")])
cases("marker_rtf", listed(markers.rtf_markers), [("{\\rtf{\\field{\\*\\fldinst DDEAUTO c:\\\\x}}}", "RTF-DDE-FIELD"), ("{\\rtf{\\object\\objupdate}}", "RTF-OBJUPDATE"), ("{\\rtf plain DDE}", "")])
cases("body_strings", listed(markers.printable_strings), [(b"\x00short\x00long enough\x00", "long enough"), ("wide text".encode("utf-16-le"), "wide text"), (b"\x01path=c:/temp/x\x02", "path=c:/temp/x|c:/temp/x"), (b"", "")])
cases("marker_binary", listed(markers.binary_markers), [(EXE + b"PK\x03\x04..PK\x05\x06", "POLYGLOT-PE-ZIP"), (EXE + b"xlAutoOpen", "XLL-ADDIN"), (EXE, ""), (b"MZ" + b"\0" * 80 + b"xlAutoOpen", ""), (b"PK\x03\x04PK\x05\x06", "")])
cases("sniff_bytes", files.kind, [
    (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1....", "ole2"), (b"PK\x03\x04", "zip"), (b"7z\xbc\xaf\x27\x1c", "7z"), (b"MSCF", "cab"), (b"\x1f\x8b\x08", "gzip"),
    (bytes.fromhex("4C0000000114020000000000C000000000000046") + b"\0" * 60, "lnk"), (b"L\0\0\0 not a link", "none"),
    (bytes.fromhex("E4525C7B8CD8A74DAEB15378D02996D3"), "onenote"), (b"\x78\x9f\x3e\x22", "tnef"), (EXE, "pe"), (b"MZ but no header" * 9, "none"),
    (b"\x7fELF\x02\x01\x01" + b"\0" * 9 + b"\x02\x00", "elf"), (b"\x7fELF\x02\x02\x01" + b"\0" * 9 + b"\x00\x03", "elf"), (b"\x7fELF\x02\x01\x01" + b"\0" * 9 + b"\x09\x00", "none"),
    (b"\xef\xbb\xbf<?mso-application progid=\"Excel.Sheet\"?>", "spreadsheet_xml"), (b"x" * 257 + b"ustar", "tar"), (b"....%PDF-1.7", "pdf"), (b"ID;P", "sylk"),
])
cases("container_magic", lambda c: encodings.container_magic(c), [(b"PK\x03\x04", "true"), (b"\xd0\xcf\x11\xe0", "true"), (b"MZ", "true"), (b"%PDF-", "true"), (b"GIF89a", "false")])
cases("extension_mismatch", lambda c: files.mismatch(F.get(F.split(c, " "), F.lit(1)), F.get(F.split(c, " "), F.lit(0))), [
    ("office-doc .PDF", "office-doc:pdf"), ("rtf .rtf", None), ("rtf .txt", "rtf:txt"), ("lnk .jpg", "lnk:jpg"), ("zip .txt", None), ("office-doc .doc", None), ("ole-package .csv", "ole-package:csv"), ("onenote .one", None), ("msi .dat", "msi:dat"),
])
cases("looks_encoded", lambda c: encodings.looks_encoded(c), [("plain words only", "false"), ("x = \"a\" & \"b\" ", "true"), ("QUJDREVGR0hJSktMTU5PUFFSU1RVVldY", "true"), ("llehSrewop", "true"), ("Environ(\"TEMP\")", "true"), ("abc+\"", "false")])
cases("decode_reversed_text", listed(encodings.reversed_text), [("elifotevas a", "a savetofile"), ("savetofile", "")])
cases("decode_base32", hexed(encodings.base32_blobs), [
    ("x JBSWY3DPFQQHI2DJOMQGS4ZAMJQXGZJTGI======", "48656C6C6F2C2074686973206973206261736533" + "32"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZABCDEFGH", ""), ("JBSWY3DPFQQHI2DJOMQGS4ZAMJQXGZJT", "48656C6C6F2C20746869732069732062617365" + "33"),
])
cases("decode_chains", listed(encodings.chained_literals), [("\"po\" & \"we\" + Chr(114) & ChrW(8364)", "power€"), ("Chr(65) & \"say \"\"hi\"\"\"", "Asay \"hi\""), ("\"alone\"", "")])
cases("decode_decimals", listed(encodings.decimal_texts), [("72,101,108,108,111,44,119,111,114,108,100,33", "Hello,world!"), ("72,101,108;108,111,44,119,111,114,108,100,33", ""), ("300,101,108,108,111,44,119,111,114,108,100,33", "")])
cases("decode_environ", listed(encodings.environ_markers), [("x = Environ(\"TEMP\") & environ$(\"APPDATA\")", "VBA-ENVIRON %TEMP%|VBA-ENVIRON %APPDATA%"), ("environment", "")])
cases("decode_utf16", encodings.transcoded, [(b"\xff\xfe" + "hi".encode("utf-16-le"), "hi"), (b"\xfe\xff" + "hi".encode("utf-16-be"), "hi"), ("sixteen bytes".encode("utf-16-le"), "sixteen bytes"), ("sixteen bytes".encode("utf-16-be"), "sixteen bytes"), (b"sixteen plain bytes", None), (b"a\0", None)])
cases("undefanged", encodings.undefanged, [("hxxps://a[.]com", "https://a.com"), ("HXXP[:]//b(dot)org", "http://b.org"), ("fxp://c{.}net", "ftp://c.net"), ("me[at]d.com", "me@d.com"), ("plain", None)])
cases("refanged", urls.refanged, [("hxxp://a[.]b", "http://a.b"), ("x{[.]}y", "x{.}y"), ("a dot b", "a.b"), ("hXXps[://]c", "https://c")])
cases("header_candidates", lambda c: F.array_join(files.header_candidates(c), "|"), [("b25lCnR3bwpvbmUKIGFiIA==", "one|two|ab"), ("", ""), ("eAlZ", "xY")])
cases("candidate_union", lambda c: F.array_join(files.candidates_in_order(F.split(c, ","), F.lit(None).cast("array<string>"), F.array(F.lit("infected"), F.lit("a"))), "|"), [(" a ,b,,b", "a|b|infected"), ("", "infected|a")])
cases("actionable", lambda c: scoring.actionable(F.str_to_map(c, F.lit(","), F.lit("="))), [("score=5", "true"), ("canary=1,score=5", "false"), ("allow=1", "false"), ("allow=0", "true")])
cases("response_tags", lambda c: F.array_join(F.array_sort(F.transform(F.map_entries(scoring.tagged(F.str_to_map(c, F.lit(","), F.lit("=")), F.contains(c, F.lit("good")), True)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ","), [("rule=good", "allow=1,canary=1,rule=good"), ("rule=bad", "canary=1,rule=bad")])
cases("filetimes", lambda c: F.date_format(files.filetime(c.cast("long")), "yyyy-MM-dd HH:mm:ss"), [("116444736000000000", "1970-01-01 00:00:00"), ("0", None), ("133485408000000000", "2024-01-01 00:00:00")])
cases("header_values", lambda c: files.header_value(c, 8), [("clean", "clean"), ("a\r\nX: y", "aX: y"), ("0123456789", "01234567")])
cases("cache_keys", lambda c: files.cache_key(F.lit("fp"), F.lit("a.doc"), F.lit(".doc"), F.lit(""), F.lit(5), F.encode(c, "UTF-8"), F.filter(F.split(c, ","), lambda x: x != "")), [
    ("", "fp:a.doc\0.doc\0\0" + "5:e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"),
    ("abc", "fp:a.doc\0.doc\0\0" + "5\0pw:ba7816bf8f01cfea:ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"),
])
cases("stream_channels", markers.channel, [("OLEID-DDE", "marker"), ("OLEID-DDE too", "content"), ("OLE-DOC-SECURITY-5", "marker"), ("XLM-STACK\nx", "marker"), ("PDF-LAUNCH", "content")])
cases("stream_rule_sets", lambda c: streams.rule_set(c, F.when(c == "m", "marker").otherwise("content")), [("a", "full"), ("b", "small"), ("m", "marker")], lambda c: F.repeat(c, F.when(c == "b", 7 << 20).otherwise(1)))
cases("byte_entropies", lambda c: F.round(structure.byte_entropy(c), 3), [(b"aaaa", "0.0"), (b"abcd", "2.0"), (bytes(range(256)), "8.0"), (b"", "0.0")])
cases("effective_sources", structure.effective_source, [("Attribute VB_Name = 1\n\n  x = 1 \n", "5"), ("", "0"), ("a\r\nbc", "3")])
