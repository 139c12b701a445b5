"""Schemas of the logical tables that are read from files."""

RESULTS = (
    "pos long, entry_id string, provider string, model string, ground_truth string, predicted_verdict string, confidence int, comments string, reason_type string, source_quote string, quote_status string, "
    "quote_verified boolean, latency_ms long, error string, correct string, tokens_in int, tokens_out int, prompt_tokens int, completion_tokens int, cost_usd double, timestamp string"
)
DATASET = (
    "id string, article_url string, article_title string, citation_number int, occurrence int, total_occurrences int, claim_text string, claim_container string, source_url string, source_text string, ground_truth string, "
    "dataset_version string, extraction_status string, needs_manual_review boolean, wice_label_projection string, wice_split string"
)
