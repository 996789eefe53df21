"""Private keys with header lines, blocks and cut ends."""

import re

from statewalk.llm import secret_scan

KEYS = [
    "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B\n\nMIIEbody+/=\nabcd\n-----END RSA PRIVATE KEY-----",
    "-----BEGIN PGP PRIVATE KEY BLOCK-----\nVersion: GnuPG v1 (x-y)\n\nlQOYBF\n=abcd\n-----END PGP PRIVATE KEY BLOCK-----",
    "-----BEGIN PRIVATE KEY-----\n" + "MIIE-abc/\n" * 30000 + "-----END PRIVATE KEY-----",
    "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B\n\nMIIEcut",
]


def test_private_keys_are_masked_whole(spark):
    df = spark.createDataFrame([(i, f"before\n{k}; after") for i, k in enumerate(KEYS)], "doc_id long, text string")
    out = secret_scan.redact(secret_scan.scan(df)).orderBy("doc_id").collect()
    assert [r["text"] for r in out] == ["before\n[redacted]; after"] * len(KEYS)
    rule = next(r for r in secret_scan.RULES if r.kind == "private_key")
    two = f"{KEYS[3]}\n{KEYS[1]}"
    assert [m.group() for m in re.finditer(rule.pattern, two)] == [KEYS[3] + "\n", KEYS[1]]
