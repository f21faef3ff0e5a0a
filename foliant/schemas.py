"""Schemas of the catalogue's tables."""

from __future__ import annotations

STEP_DONE = "array<struct<name:string,completed_at:timestamp,result:string>>"
STEP_FAILED = "array<struct<name:string,failed_at:timestamp,error:string>>"

PAPER = """doc_id string, content_id string, filename string, file_path string, ocr_text string, ocr_quality string,
 created_at timestamp, updated_at timestamp, ocr_quality_completed boolean, layout_completed boolean,
 metadata_llm_completed boolean, processing_notes string, original_file_path string, ocr_regenerated boolean"""
METADATA = """paper_id string, title string, authors array<string>, journal string, year int, doi string,
 abstract string, keywords array<string>, created_at timestamp"""
PAGE_EMBEDDING = "paper_id string, page_number int, page_text string, embedding array<float>, vector_dim int, model_name string, created_at timestamp"
EMBEDDING = "paper_id string, embedding array<float>, vector_dim int, model_name string, created_at timestamp"
LAYOUT_PAGES = "array<struct<page_number:int,width:double,height:double,elements:array<struct<type:string,bbox:array<double>,confidence:double,text:string,properties:map<string,string>>>>>"
FILE_HASH = "file_md5 string, file_size bigint, original_filename string, paper_id string, created_at timestamp"
CONTENT_HASH = """content_hash string, pdf_title string, pdf_author string, pdf_creator string, first_three_pages_text string,
 page_count int, paper_id string, created_at timestamp"""
SAMPLE_HASH = """embedding_hash string, sample_strategy string, sample_text string, embedding array<float>, vector_dim int,
 model_name string, paper_id string, created_at timestamp"""
DETECTION_LOG = """detection_id string, filename string, file_size bigint, detection_result string, detection_layer string,
 duplicate_paper_id string, total_processing_time double, layer_0_time double, layer_1_time double, layer_2_time double,
 time_saved double, error_message string, created_at timestamp"""
JOB = f"""job_id string, paper_id string, filename string, status string, current_step string, progress_percentage int,
 steps_completed {STEP_DONE}, steps_failed {STEP_FAILED}, error_message string, result_summary string, created_at timestamp,
 started_at timestamp, completed_at timestamp, ocr_quality_pending boolean, layout_pending boolean, metadata_llm_pending boolean"""
BACKUP = """backup_id string, type string, path string, timestamp timestamp, size_bytes bigint, compressed boolean,
 description string, retention_days int, expire_date timestamp, checksum string, status string, error string"""
