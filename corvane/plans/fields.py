"""Fields of an instance record."""

REQUIRED = """actual_engine_confidence actual_engine_result allocation_key corpus_role difficulty doc_id expected_confidence
expected_engine_outcome extraction_found file_name normalized_value pair_id pattern_branch proximity_bucket sample_uuid sit_key
source_inventory_id split validation_status value value_end_offset value_kind""".split()

#: Fields of some deliveries alone: empty everywhere is fine, empty here and there is not.
SCHEMA_AWARE = "chunk_label entity_guid engine_variant_expectations sit_name failure_reason".split()
