"""The explicit schema of business records."""

from __future__ import annotations

#: As DDL text: nested and fixed; keys that are not named go to the column EXTRA where readers are asked for it.
BUSINESS = """business_name string, place_id string, google_maps_url string,
    address struct<full_address:string, street:string, city:string, state:string, postal_code:string, country:string>,
    coordinates struct<latitude:double, longitude:double>,
    contact struct<phone:string, phone_international:string, website:string, email:string>,
    social_media struct<facebook:string, instagram:string, twitter:string, linkedin:string, youtube:string, tiktok:string>,
    business_info struct<category:string, all_categories:array<string>, description:string, price_level:string, years_in_business:string>,
    ratings struct<average_rating:double, total_reviews:int, rating_distribution:struct<five_star:int, four_star:int, three_star:int, two_star:int, one_star:int>>,
    hours struct<is_open_now:boolean, current_status:string, hours_by_day:struct<monday:string, tuesday:string, wednesday:string, thursday:string, friday:string, saturday:string, sunday:string>, special_hours:array<string>>,
    attributes struct<amenities:array<string>, accessibility:array<string>, payments_accepted:array<string>, service_options:array<string>, highlights:array<string>, crowd:array<string>, planning:array<string>>,
    images struct<main_image_url:string, all_image_urls:array<string>>,
    reviews_sample array<struct<author:string, rating:double, text:string, date:string, language:string>>,
    metadata struct<scraped_at:string, data_freshness:string, verification_status:string, scraper_version:string, query:string, has_warnings:boolean, warnings:array<string>>"""
CORRUPT = "_corrupt_record"
#: Unknown keys: names, with the outer one and a point before those of nested records, and their values as JSON text.
EXTRA = "_extra"
