"""The answer-parsing truth table (gold relevant = true), as in FIXTURES.md section 3."""

R = '"reason": {"query_topic": "a", "document_topic": "a", "summary": "s"}'
EXACT = '{"relevant": true, ' + R + '}'
FENCE = "```"

# (case, text, lenient flag, strict valid, strict match, complete, judge flag)
CASES = [
    ("exact", EXACT, True, 1, 1, 1, True),
    ("fenced", FENCE + "json\n" + EXACT + "\n" + FENCE, True, 0, 0, 0, False),
    ("prose prefix", "Answer: " + EXACT, True, 0, 0, 0, False),
    ("trailing text", EXACT + " done", True, 0, 0, 0, False),
    ("truncated", '{"relevant": true, "reason": {"query_to', True, 0, 0, 0, False),
    ("flipped", '{"relevant": false, ' + R + '}', False, 1, 0, 1, False),
    ("string flag", '{"relevant": "false", ' + R + '}', True, 1, 0, 1, True),
    ("number 1", '{"relevant": 1, ' + R + '}', True, 1, 1, 1, True),
    ("number 0", '{"relevant": 0, ' + R + '}', False, 1, 0, 1, False),
    ("null flag", '{"relevant": null, ' + R + '}', False, 1, 0, 1, False),
    ("flag missing", '{' + R + '}', False, 1, 0, 1, False),
    ("reason missing", '{"relevant": true}', True, 1, 1, 0, True),
    ("reason partial", '{"relevant": true, "reason": {"query_topic": "a"}}', True, 1, 1, 0, True),
    ("reason string", '{"relevant": true, "reason": "matches"}', True, 1, 1, 0, True),
    ("reason null", '{"relevant": true, "reason": null}', True, 1, 1, 0, True),
    ("Python boolean", '{"relevant": True, ' + R + '}', True, 0, 0, 0, False),
    ("upper case", '{"relevant": TRUE, ' + R + '}', None, 0, 0, 0, False),
    ("bare true", "true", None, 1, 0, 0, False),
    ("array", '[{"relevant": true}]', True, 1, 0, 0, False),
    ("two objects", '{"relevant": true}\n{"relevant": false}', True, 0, 0, 0, False),
    ("empty", "", None, 0, 0, 0, False),
    ("single quotes", "{'relevant': true}", None, 0, 0, 0, False),
]
