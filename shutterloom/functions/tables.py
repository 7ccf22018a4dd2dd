"""Fixed values that results depend on: event rules, subject names, name variants, display terms. Data only."""

from __future__ import annotations

from typing import NamedTuple

class EventRule(NamedTuple):
    """What a selection of an event's photos must hold."""

    tag_groups: list[list[str]] = []
    landmarks: int = 0
    cheering: tuple[int, int] = (0, 0)
    transit_most: int | None = None
    by_class: bool = False
    by_day: bool = False
    ball: bool = False


# The rules of each kind of event.
EVENT_RULES = {
    "general": EventRule(),
    "entrance_ceremony": EventRule(tag_groups=[["entrance sign", "memorial"], ["full group", "group shot"], ["procession", "entrance procession"], ["principal speech"], ["student representative speech", "representative speech"], ["homeroom teacher introduction", "teacher introduction"]]),
    "field_trip": EventRule(tag_groups=[["landmark", "destination"]], landmarks=2, transit_most=2),
    "sports_festival": EventRule(tag_groups=[["athlete oath"], ["award ceremony", "results announcement"]], cheering=(1, 2), by_class=True),
    "other_athletic": EventRule(tag_groups=[["start"], ["finish"]], cheering=(0, 1), ball=True),
    "cultural_festival": EventRule(tag_groups=[["stage performance"], ["class exhibit", "entrance gate", "club activity"]], by_class=True),
    "other_cultural": EventRule(tag_groups=[["award ceremony"], ["group shot"]], by_class=True),
    "school_trip": EventRule(tag_groups=[["landmark", "destination"]], landmarks=2, transit_most=2, by_day=True),
    "other_off_campus": EventRule(tag_groups=[["landmark", "destination"]], landmarks=1, transit_most=2, by_day=True),
}

# Words in folder names, in the order in which they are tried.
EVENT_HINTS = (
    ("entrance_ceremony", ("entrance_ceremony", "school_entrance", "entrance ceremony", "入学式", "school entrance")),
    ("field_trip", ("field_trip", "field trip", "遠足")),
    ("sports_festival", ("sports_festival", "sport_event", "sports event", "体育祭", "athletic_meet")),
    ("other_athletic", ("marathon", "ball game", "ball_game", "relay", "athletic")),
    ("cultural_festival", ("cultural_festival", "cultural festival", "文化祭")),
    ("other_cultural", ("choir", "speech_contest", "speech contest", "合唱", "弁論")),
    ("school_trip", ("school_trip", "school trip", "修学旅行")),
    ("other_off_campus", ("forest school", "british hills", "off_campus", "校外")),
)

# Other names of event kinds; a kind is also its own name.
EVENT_ALIASES = {
    "entrance": "entrance_ceremony",
    "sports": "sports_festival",
    "athletic": "other_athletic",
    "cultural": "cultural_festival",
    "off_campus": "other_off_campus",
} | {k: k for k in EVENT_RULES}

# Tag words of pictures on the way or at meals.
TRANSIT_TERMS = ("transit", "train", "plane", "meal", "lunch", "food", "移動中", "電車", "飛行機", "食事", "昼食")

# Subjects and offices in display order.
SUBJECT_ORDER = [
    "校長", "副校長", "教頭", "主幹教諭", "養護", "養護教諭", "司書", "図書館専門員", "ICT支援員", "スクールカウンセラー", "用務専門員", "学校医", "学校歯科医", "学校薬剤師", "産業医", "国語", "現代文", "古文",
    "漢文", "書道", "数学", "数Ⅰ", "数Ⅱ", "数A", "数B", "数C", "英語", "外国語", "社会", "地理", "日本史", "世界史", "公民", "政経", "倫理", "地歴公民", "理科", "物理", "化学", "生物", "地学",
    "保健体育", "体育", "音楽", "美術", "芸術", "家庭", "情報",
]

# Short and misread subject names.
SUBJECT_ALIASES = {
    "外国語": "英語", "保体": "保健体育", "保健・体育": "保健体育", "保健体育科": "保健体育", "理": "理科", "数": "数学", "英": "英語", "国": "国語",
    "社": "地歴公民", "音": "音楽", "美": "美術", "家": "家庭", "養護教員": "養護教諭", "養護": "養護教諭", "副校長先生": "副校長", "校長先生": "校長",
    "教愛": "教頭", "書": "書道", "体": "保健体育", "地歴": "地歴公民", "公民": "地歴公民", "社会": "地歴公民", "地理歴史": "地歴公民", "地歴公民科": "地歴公民",
}

# Offices that count as subjects.
ROLE_SUBJECTS = [
    "校長", "副校長", "教頭", "主幹教諭", "養護", "養護教諭", "図書館専門員", "ICT支援員", "スクールカウンセラー", "用務専門員", "司書", "学校医", "学校歯科医", "学校薬剤師", "産業医", "主事", "主任", "課長代理",
    "経営企画室長", "建築物環境衛生技術者",
]

# Old and variant forms of name characters, each with its standard form.
NAME_VARIANTS = {
    "齋": "斉", "齊": "斉", "斎": "斉", "髙": "高", "﨑": "崎", "＋": "崎", "邊": "辺", "邉": "辺", "濱": "浜", "澤": "沢", "榮": "栄", "廣": "広", "國": "国", "實": "実",
    "眞": "真", "壽": "寿", "寬": "寛", "櫻": "桜",
}
HONORIFICS = ("教員", "教諭", "講師", "先生")
NOISE_WORDS = ("名不鮮明", "姓不鮮明", "判読不明", "不鮮明", "不明", "暫定", "推定", "可能性", "先生", "教諭", "講師", "教員")
DOUBT_WORDS = ("不鮮明", "不明", "判読", "暫定", "推定", "可能性", "一部不明")

# Terms of result tables, replaced in this order wherever they occur.
DISPLAY_TERMS = {
    "eyes closed": "目つぶり", "unreadable": "読み取り不可", "placard visible": "札写り込み", "low-sharp": "ピント不足", "blurry": "ピント不足", "dark": "暗い",
    "no face detected": "顔検出なし", "gesture": "不適切なポーズの可能性", "middle finger": "中指を立てている", "obscene pose": "不適切なポーズ", "improper pose": "不適切なポーズ",
    "selected as best shot": "ベストショットとして選定", "passed but not selected": "通過写真（ベストショット未選定）", "NG photo": "NG写真",
    "error": "エラー", "warning": "警告", "info": "情報", "no_card_detected": "札検出なし", "multiple_card_detected": "複数札検出", "missing_tag_shot": "札写真不足",
    "unresolved": "未解決", "resolved": "解決済み", "needs_review": "要確認", "unknown": "不明", "openai_error": "OpenAI OCRエラー",
    "label_letter_mismatch": "クラス文字不一致", "invalid_or_uncertain_label": "無効または不確実な札番号", "no clear card visible": "明確な札が見えません",
    "matched": "照合済み", "unmatched": "未照合", "assigned": "割当済み", "unassigned": "未割当", "best shot": "ベストショット", "processed": "処理済み",
    "no match": "一致なし", "low confidence": "信頼度低", "missing card": "札なし", "OCR failed": "OCR失敗", "face mismatch": "顔不一致", "name mismatch": "氏名不一致",
    "subject mismatch": "教科不一致", "Well-organized": "整列・構図が良好", "Well-composed": "構図が良好", "Bright": "明るさが良好", "energetic": "活気がある",
    "obscene": "不適切なポーズ", "true": "はい", "false": "いいえ", "True": "はい", "False": "いいえ",
}

# Display names of columns: of all tables, of event tables, of club tables and of staff tables.
GENERAL_HEADERS = {
    "Summary": "サマリー", "metric": "項目", "value": "値", "file_name": "ファイル名", "file": "ファイル名", "original_file": "元ファイル名", "renamed_file": "リネーム後ファイル名",
    "shooting_date": "撮影日", "rank": "順位", "status": "ステータス", "reason": "理由", "description": "説明", "comment": "コメント", "error_type": "エラー種別",
    "severity": "重要度", "detection_layer": "検出レイヤー", "detection_unit": "検出レイヤー", "class_id": "クラス", "group_key": "グループキー", "group_idx": "グループ番号",
    "student_number": "出席番号", "image_path": "画像パス", "group_keys": "関連グループキー", "related_paths": "関連画像パス", "message": "メッセージ",
}
EVENT_HEADERS = {
    "event_id": "イベントID", "event_name": "イベント名", "display_event_name": "表示イベント名", "total_input_images": "入力画像数", "total_clusters": "類似グループ数",
    "total_representative_candidates": "代表候補写真数", "dedup_reduction_rate": "重複削減率", "best_shot_count": "ベストショット指定枚数",
    "final_selected_count": "ベストショット選定枚数", "ng_count_after_menna": "NG写真枚数", "other_passing_count": "通過写真枚数", "output_folder": "出力フォルダ",
    "cluster_id": "類似グループID", "capture_time": "撮影日時", "is_representative": "代表写真", "bucket": "区分",
}
CLUB_HEADERS = {
    "club": "部活動名", "club_count": "部活動数", "photo_count": "写真枚数", "closed_eye_photo_count": "目つぶり写真枚数", "closed_eye_face_count": "目つぶり人数",
    "ranked_output_count": "順位付け出力枚数", "person_count": "人数", "closed_eye_faces": "目つぶり人数", "eyes_closed_photo": "目つぶり写真", "face_index": "顔番号",
    "bbox": "顔領域", "left_eye_ratio": "左目開眼比率", "right_eye_ratio": "右目開眼比率", "eye_closed": "目つぶり", "formality": "整列・構図", "quality": "品質",
    "expression": "表情", "gesture_penalty": "ポーズ減点", "obscured_penalty": "遮蔽減点", "ng_flag": "NG判定", "total_score": "総合スコア", "beauty_score": "画質・見栄え",
    "expression_score": "表情スコア", "emotion_score": "雰囲気スコア", "people_count_score": "人数スコア", "gesture_expression_penalty": "ポーズ減点",
    "short_comment": "コメント", "is_ng": "NG判定", "ng_reason": "NG理由",
}
STAFF_HEADERS = {
    "Original Filename": "元ファイル名", "Renamed Filename": "リネーム後ファイル名", "Image Path": "画像パス", "Card Name (OCR)": "札氏名（OCR）",
    "Card Subject (OCR)": "札教科（OCR）", "Match Score": "照合スコア", "Status": "ステータス", "Reason": "理由", "Comment": "コメント", "Subject": "教科", "Role": "役職",
    "Name": "氏名", "Surname": "姓", "Given Name": "名", "Full Name": "氏名", "Staff Name": "教職員名", "Best Shot Score": "ベストショットスコア", "Score": "スコア",
    "Rank": "順位", "File": "ファイル", "Filename": "ファイル名", "Teacher Name": "教員名", "Card Name": "札氏名", "Card Subject": "札教科", "OCR Result": "OCR結果",
    "Confidence": "信頼度", "Final Name": "最終氏名", "Final Filename": "最終ファイル名", "Matched Name": "照合氏名", "Matched Subject": "照合教科",
    "Match Status": "照合ステータス", "Match Results": "照合結果", "Card OCR Confidence": "OCR信頼度", "Card Uncertain Chars": "OCR不確実文字", "Match Method": "照合方法",
    "PDF Matched Name": "照合氏名", "PDF Role / Admin Tags": "役職 / 管理タグ", "PDF Academic Subjects": "PDF教科",
    "PDF All Subjects (incl. roles)": "PDF全教科（役職含む）", "PDF Classes / Grades": "PDF担当クラス・学年", "PDF Presence": "在籍情報", "PDF Source Types": "情報ソース種別",
    "PDF Source Files": "PDF元ファイル", "PDF Pages": "PDFページ", "PDF Extraction Confidence": "PDF抽出信頼度", "PDF Notes": "備考", "PDF Name Aliases": "氏名別名",
    "Destination": "出力先", "Academic Subjects": "教科", "Role / Admin Tags": "役職 / 管理タグ", "All Subjects": "全教科", "Classes / Grades": "担当クラス・学年",
    "Presence": "在籍情報", "Source Types": "情報ソース種別", "Source Files": "情報元ファイル", "PDF Extraction Conf": "PDF抽出信頼度", "Notes": "備考",
    "Name Aliases": "氏名別名", "Final Teacher Name": "最終氏名", "Name Source": "氏名ソース", "Card OCR Name": "札氏名（OCR）", "Teacher (roster name)": "教職員名（名簿）",
    "Suitability (0-10)": "適正（0-10）", "Beauty (0-10)": "品質（0-10）", "Expression (0-10)": "表情（0-10）", "Composite Score": "総合スコア", "Is NG": "NG判定",
    "NG Reason": "NG理由", "Short Comment": "コメント", "Selected Best Shot": "ベストショット選定", "Subject / Role": "教科 / 役職", "Extraction Confidence": "抽出信頼度",
}

# Display names of the buckets, and of the sheets of event, club and staff workbooks.
BUCKETS = {
    "final_selected": "ベストショット", "ng": "NG写真", "other_passing": "通過写真",
}
EVENT_SHEETS = {
    "all_events_summary": "全イベントサマリー", "summary": "サマリー", "clusters": "類似グループ", "selection": "選定結果",
}
CLUB_SHEETS = {
    "Summary": "サマリー", "Eye Closure Summary": "目つぶり確認サマリー", "Face Detail": "顔検出詳細", "Best Shot Ranking": "ベストショット順位", "Rename Output": "リネーム結果",
}
STAFF_SHEETS = {
    "Match Results": "照合結果", "PDF Staff Master": "PDF教職員マスター", "Final Name List": "最終氏名リスト", "Best Shot Scores": "ベストショットスコア",
    "Staff by Subject": "教科別教職員",
}

#: A column's display name; where several tables name it, the first of them.
HEADERS = STAFF_HEADERS | CLUB_HEADERS | EVENT_HEADERS | GENERAL_HEADERS

# Other names of error types.
ERROR_ALIASES = {
    "no_card_detected": "no_card_detected", "card_not_detected": "no_card_detected", "札未検出": "no_card_detected", "missing_tag_shot": "no_card_detected",
    "multiple_card_detected": "multiple_card_detected", "multiple_card_holders": "multiple_card_detected", "複数札検出": "multiple_card_detected",
    "duplicate_number": "multiple_card_detected",
}

# Media types by suffix, and suffixes of pictures.
MEDIA_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "gif": "image/gif", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff"}
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "webp", "bmp", "tif", "tiff", "heic", "heif")
