"""Tables of the engine as Spark schemas. Bodies that a row store would keep aside are plain columns here: column pruning makes that free."""

PARAMS = "array<struct<name:string,kind:string,has_default:boolean,default_repr:string,is_literal:boolean>>"
TABLES = {
    "repos": "repo_id long, name string, path string, last_code_sha string, last_doc_sha string",
    "code_chunks": "id long, repo_id long, file_path string, symbol_name string, symbol_type string, start_line int, end_line int, source_text string, docstring string, ast_hash string, embedding array<float>, embedding_id string",
    "doc_chunks": "id long, repo_id long, file_path string, heading string, heading_level int, text string, code_blocks array<string>, start_line int, end_line int, embedding array<float>, embedding_id string",
    "claims": "id long, repo_id long, doc_chunk_id long, claim_text string, claim_type string, referenced_symbol_guess string",
    "retrieval_results": "id long, repo_id long, claim_id long, matched_code_chunk_id long, match_status string, top_k array<struct<code_chunk_id:long,symbol_name:string,score:double>>, retrieved_at timestamp",
    "verification_results": "id long, repo_id long, claim_id long, matched_code_chunk_id long, status string, actual_value string, claimed_value string, verified_at timestamp",
    "file_cache": "repo_id long, file_path string, file_type string, content_hash string, last_processed_commit_sha string, last_processed_at timestamp",
}
#: Claim types, statuses in order of severity, match outcomes.
CLAIM_TYPES = ("signature", "default_value", "env_var", "return_type", "behavior")
STATUSES = ("Contradicted", "Unverifiable", "Verified")
MATCHES = ("matched", "ambiguous", "no_match")
