"""Schemas of the tables that pass between the stages, as DDL. Readers are always given one; nothing is inferred."""

RECORD = "relative_path string, content string, metadata map<string,string>, record_index bigint, custom_id string"
SUMMARY_ROW = "custom_id string, markdown_content string, seed_questions array<string>, summary string, name string, description string, metadata map<string,string>"
SCENARIO_ROW = SUMMARY_ROW + ", scenario_output array<struct<scenario: string, question: string>>"
VALIDATED_ROW = "custom_id string, name string, markdown_content string, description string, reasoning string, filtered_questions array<string>, num_from_seed_questions string, num_from_scenario_questions string"

#: Strict payloads: key to type, `strings` an array of strings, with the exact length where one is declared.
EXTRACTION = {"reasoning": "string", "what": "string", "why": "string", "seed_questions": "strings"}
SUMMARY = {"summary": "string", "seed_questions": "strings"}
SCENARIOS = {"scenario_output": ("scenarios", 5)}
FILTERED = {"reasoning": "string", "filtered_questions": ("strings", 5)}
