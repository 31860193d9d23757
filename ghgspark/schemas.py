"""Column layouts shared by the operators."""

from __future__ import annotations

LINES = "file STRING, block BIGINT, pos BIGINT, value STRING"

LINE_ITEM = (
    "struct<meter_id:string,energy_type:string,period_from:string,period_to:string,"
    "consumption_kwh:double,unit_price:double,amount_eur:double,consumption_unit:string>"
)
LINE_ITEM_FIELDS = (
    "meter_id", "energy_type", "period_from", "period_to",
    "consumption_kwh", "unit_price", "amount_eur", "consumption_unit",
)

PARSED_COLUMNS = (
    "filename", "file_hash", "raw_text", "vendor_name", "customer_name", "site_address", "address",
    "invoice_number", "invoice_date", "currency", "billing_period_from", "billing_period_to",
    "line_items", "subtotal", "network_levies", "vat_amount", "total_amount",
    "blob_name", "row_hash", "success", "error", "warnings",
)

RECORD_COLUMNS = {
    "filename": "string",
    "pdf_hash": "string",
    "vendor_name": "string",
    "customer_name": "string",
    "site": "string",
    "invoice_number": "string",
    "invoice_date": "string",
    "billing_period_from": "string",
    "billing_period_to": "string",
    "energy_type": "string",
    "consumption_kwh": "double",
    "consumption_unit": "string",
    "total_eur": "double",
    "currency": "string",
    "emissions_tco2": "double",
    "emission_factor_value": "double",
    "emission_factor_source": "string",
    "content": "string",
}

FACTORS = "name STRING, energy_type STRING, value DOUBLE, unit STRING, source STRING, year INT, note STRING"
ERRORS = "filename STRING, error_type STRING, message STRING, timestamp STRING"
