"""Settings of the page pipeline. Word lists, patterns and limits are fixed values of the data format."""

from __future__ import annotations

from dataclasses import dataclass

#: Labels that announce a model number or a specification, by category, in order of precedence.
MODEL, SPEC = "model", "규격"
LABEL_KEYWORDS = {
    MODEL: [
        "모델명", "모델번호", "모델", "형번", "품번", "제품번호", "제품코드", "model name", "model no", "model number", "model",
        "type", "type no", "part no", "part number", "p/n", "sku", "ordering code", "mlfb", "품목번호",
    ],
    SPEC: ["사이즈", "규격", "치수", "크기", "사양", "스펙", "제품사양", "size", "dimension", "dimensions", "specification", "spec"],
}
#: What looks like a model number.
MODEL_PATTERNS = [r"\b[A-Z]{1,6}[-/][A-Z0-9]{1,10}(?:[-/][A-Z0-9]{1,10})*\b", r"\b\d{2,4}-\d{2,6}\b"]
#: Fixed value: separators between the parts of a page title.
TITLE_SEPARATORS = r"\s*[|｜:：>›≫»]\s*|\s+-\s+"
#: Fixed value: what a page says that keeps robots out.
BLOCKED_PATTERN = (
    r"access\s*denied|request\s*blocked|unusual\s*traffic|automated\s*(request|access)|just\s*a\s*moment|checking\s*your\s*browser|"
    r"cloudflare|비정상적인?\s*접근|접근이?\s*(제한|차단)|봇\s*(확인|검토)|검토\s*번호"
)
#: Fixed value: buttons that unfold more of a page.
MORE_PATTERN = r"상세\s*(정보|설명)\s*더\s*보기|상품\s*정보\s*더\s*보기|전체\s*보기|더보기|view\s*more|show\s*more|more\s*details?"
#: Domains that are not captured, requests that are not made.
EXCLUDED_DOMAINS = ["naver.com", "coupang.com", "auction.co.kr", "gmarket.co.kr"]
BLOCKED_RESOURCES = ["media", "font"]
BLOCKED_URLS = [
    "google-analytics.com", "googletagmanager.com", "doubleclick.net", "googlesyndication.com", "facebook.com/tr", "connect.facebook.net", "hotjar.com",
    "criteo.com", "amazon-adsystem.com", "channel.io", "channel.talk", "mixpanel.com", "adsystem",
]
#: Where the product stands on the pages of a host; elsewhere in main.
REGION_SELECTORS = {
    "www.festo.com": ["main", "[data-testid='product-detail']", "#main-content"],
    "mall.industry.siemens.com": ["main", "#content", ".product-detail"],
    "kr.misumi-ec.com": ["main", "#product-detail", ".product-detail"],
    "products.swagelok.com": ["main", "#main-content", ".product-detail"],
    "item.gmarket.co.kr": ["#container", "#itemcase_basic", "main"],
    "itempage3.auction.co.kr": ["#container", "#itemcase_basic", "main"],
}
#: Wording of the documents that the pipeline writes.
NO_TITLE, NO_CONTENT, CUT = "(제목 없음)", "(내용 없음)", "\n...(생략)"
REGION_HEADING, TABLES_HEADING, TEXT_HEADING, OCR_HEADING = "## 상품 영역", "## 규격 테이블", "## 전체 텍스트 (참고)", "## 이미지 OCR"
TABLE_HEADING, IMAGE_HEADING = "### 표 ", "### 이미지 "
STATUS_KEY, NAME_KEY, SPECS_KEY = "상태", "상품명", "규격"


@dataclass(frozen=True)
class Settings:
    """Limits that a run may change."""

    most_assets: int = 60
    asset_width: int = 250
    asset_height: int = 80
    region_width: int = 300
    region_height: int = 150
    open_references: bool = True  # whether &amp counts without its semicolon
    upscale_width: int = 700
    upscale_most: float = 3.0
    stretch_cutoff: int = 1  # per cent, as the next two
    contrast_per_cent: int = 115
    sharpness_per_cent: int = 160
    tile_height: int = 1200
    tile_overlap: int = 100
    least_confidence: float = 0.30
    overlap_limit: float = 0.5
    row_tolerance: float = 0.6
    column_gap: float = 2.5
    source_chars: int = 10_000
    snippet_chars: int = 3000
    blocked_chars: int = 1500
    legacy_chars: int = 2000
    engine: str = "model"  # or "rules", which asks no model even if there is one
    model_name: str = "qwen3:4b"
    model_tokens: int = 1500
    model_context: int = 12_288
    attempts: int = 3
    wait_seconds: float = 8.0
    read_seconds: float = 300.0  # for one image
    answer_seconds: float = 600.0  # for one request


DEFAULT = Settings()
