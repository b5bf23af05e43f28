"""Small SQL fragments used in several check queries."""


def score(seed: str, *ids: str) -> str:
    parts = ", ".join(f"cast({i} AS VARCHAR)" for i in ids)
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', {parts})), 1, 4))::int"


def shuffle(seed: str, *ids: str) -> str:
    parts = ", ".join(f"cast({i} AS VARCHAR)" for i in ids)
    return f"md5(concat_ws('|', '{seed}', {parts}))"


def words(text: str) -> str:
    return rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+')"


def student_p(t: str, degrees: str) -> str:
    """Two-sided p-value of a t statistic: Simpson's rule over 40 units of the density's tail."""
    density = f"pow(1 + pow(abs({t}) + i / 100.0, 2) / ({degrees}), -(({degrees}) + 1) / 2.0)"
    sums = f"list_sum(list_transform(range(0, 4001), lambda i: CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * {density}))"
    return f"2 * exp(lgamma((({degrees}) + 1) / 2.0) - lgamma(({degrees}) / 2.0)) / sqrt(({degrees}) * pi()) * {sums} / 300.0"


def tokens(text: str) -> str:
    """Estimated tokens: whitespace words times 1.33, rounded up."""
    return rf"ceil(round(len(regexp_extract_all({text}, '[^ \n\t]+')) * 1.33::double, 6))::bigint".replace(
        r"\n", "\\n").replace(r"\t", "\\t")
