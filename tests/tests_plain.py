"""Rules written out step by step, for several test files."""


def plain_ranges(sizes, target, overlap):
    """Take paragraphs until the target is reached; take up the last ones again until the overlap is reached, never the first."""
    out, start = [], 0
    while start < len(sizes):
        end = start
        while end < len(sizes) and (end == start or sum(s + 2 for s in sizes[start:end]) < target):
            end += 1
        out.append((start, end))
        if end == len(sizes):
            break
        back = end
        while back > start + 1 and sum(sizes[back:end]) < overlap:
            back -= 1
        start = max(start + 1, back)
    return out
